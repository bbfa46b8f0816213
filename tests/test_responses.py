"""Broken JSON is mended or kept apart; ROUGE with stems."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.operators import metrics
from lattica.sources import responses

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(10**6), 10**6) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8), lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text(max_size=4), v, max_size=4), max_leaves=12)
ROOTS = st.lists(VALUES, max_size=4) | st.dictionaries(st.text(max_size=4), VALUES, max_size=4)


@settings(max_examples=300, deadline=None)
@given(ROOTS, st.integers(0, 200), st.booleans())
def test_a_prefix_of_json_is_json_again(value, n, ascii_only):
    text = json.dumps(value, ensure_ascii=ascii_only)
    assert json.loads(responses.mended("Sure! " + text + " That's all.")) == value
    found = responses.mended(text[:n])
    assert (found is None) == (n == 0)
    if n:
        assert isinstance(json.loads(found), type(value))


def test_what_is_kept_of_broken_json():
    cases = {'{"a": 1, "b': '{"a": 1}', '{"a": [1, 2, {"c": "d': '{"a": [1, 2, {"c": "d"}]}', '[1, 2,]': "[1, 2]", '{"a": tru': "{}", '{"a": 1,}': '{"a": 1}', '["x\ny"]': '["x\\ny"]', '{"a": 12.': "{}", '["a", "b\\': '["a", "b"]', "[1}": "[1]"}
    for text, want in cases.items():
        assert json.loads(responses.mended(text)) == json.loads(want), text
    assert responses.mended("no value") is None and responses.mended("") is None


def test_rows_and_dead_letters(spark):
    rows = [(1, '{"triples": [["a", "is", "b"], ["a", "is", "b"], ["", "is", "c"]]}'), (2, 'Here:\n```json\n[{"head": "x", "relation": "in", "tail": "y"}]\n```'), (3, '[["p", "by", "q"], ["r", "by", "s'), (4, "I can't."), (5, None), (6, "  "), (7, '{"fact": [["m", "n", "o"]]} done'), (8, "}{")]
    df = spark.createDataFrame(rows, "id int, text string")
    good, dead = responses.read_responses(df, "text")
    assert {r.id: r.attempts for r in good.collect()} == {1: 1, 2: 2, 3: 3, 7: 1, 8: 3}  # what follows a whole value is no matter to the parser
    assert {r.id: r.why for r in dead.collect()} == {4: "no bracket", 5: "blank", 6: "blank"}
    found = {(r.id, r.subject, r.predicate, r.object) for r in responses.triples_of(good, ["id"]).collect()}
    assert found == {(1, "a", "is", "b"), (2, "x", "in", "y"), (3, "p", "by", "q"), (3, "r", "by", "s"), (7, "m", "n", "o")}
    good, dead = responses.read_responses(df.limit(0), "text")
    assert good.count() == dead.count() == 0


def test_rouge_with_stems(spark):
    df = spark.createDataFrame([(1, "The cats were running, happily!", "a cat runs happily"), (2, "", "x"), (3, None, None), (4, "relational databases", "relate database's")], "id int, p string, g string")
    rows = {r.id: r for r in metrics.rouge_stemmed(df, ["id"], "p", "g").collect()}
    # the cat were run happili / a cat run happili
    assert abs(rows[1].rouge1 - 2 * 3 / 9) < 1e-9 and abs(rows[1].rouge2 - 2 * 1 / 7) < 1e-9 and abs(rows[1].rouge_l - 2 * 3 / 9) < 1e-9
    assert rows[2].rouge1 == rows[3].rouge1 == 0.0 and len(rows) == 4
    assert abs(rows[4].rouge1 - 2 * 2 / 5) < 1e-9


def test_rouge_of_long_texts_takes_no_square_of_their_words(spark):
    import random
    import time

    draw = random.Random(4)
    texts = [" ".join(draw.choices("abcdefgh", k=draw.randrange(0, 12))) for _ in range(60)]
    df = spark.createDataFrame([(i, p, g) for i, (p, g) in enumerate(zip(texts, texts[1:], strict=False))], "id long, p string, g string").select("id", metrics.words("p").alias("p"), metrics.words("g").alias("g"))

    def longest(p, g):
        row = [0] * (len(g) + 1)
        for x in p:
            before, row = row, [0] * (len(g) + 1)
            for j, y in enumerate(g, 1):
                row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
        return row[-1]

    for p, g, r, r1, r2, rl in df.select("p", "g", metrics.rouge("p", "g").alias("r"), metrics.gram_score("p", "g", 1), metrics.gram_score("p", "g", 2), metrics.rouge_l("p", "g")).collect():
        assert tuple(r) == (r1, r2, rl)
        assert rl == (2.0 * longest(p, g) / (len(p) + len(g)) if longest(p, g) else 0.0)
    many = [" ".join(draw.choices([f"w{k}" for k in range(3000)], k=20_000)) for _ in range(2)]
    df = spark.createDataFrame([many], "p string, g string")
    start = time.perf_counter()
    assert 0 < df.select(metrics.rouge(metrics.words("p"), metrics.words("g"))["rouge_l"]).first()[0] < 1
    assert time.perf_counter() - start < 15
