"""Normalisers, the store and graph iteration on toy data."""

import pytest
from pyspark.sql import functions as F

from lattica.functions import text
from lattica.operators import graph, metrics, search, store
from lattica.operators.components import connected_components
from lattica.sources import files


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "c string").select(expr("c").alias("r")).first().r


@pytest.mark.parametrize(
    ("value", "want"),
    [("  a  b​ ", "a b"), (None, ""), ("", "")],
)
def test_normalize_text(spark, value, want):
    assert one(spark, value, text.normalize_text) == want


@pytest.mark.parametrize(("value", "want"), [("Maung  Wunna (film)", "maung wunna"), ("STRASSE ß", "strasse ss"), ("?", "symbol:?"), ("ΣΞ ς", "σξ σ"), ("A-1/b", "a 1 b"), ("ﬁn", "fin")])
def test_canonical_key(spark, value, want):
    assert one(spark, value, text.canonical_entity_key) == want


@pytest.mark.parametrize("value", ["İstanbul", "ŉ", "ǰ", "ΐ", "µ", "ſ", "Ǆ", "ẞ", "ﬃ", "Ϊ́"])
def test_casefold_is_pythons(spark, value):
    assert one(spark, value, text.casefold) == value.casefold()


@pytest.mark.parametrize(("value", "want"), [("a (b", "a (b)"), ("a b))", "a b"), ("(a)", "(a)"), ("a)b", "a)b")])
def test_balanced(spark, value, want):
    assert one(spark, value, text.balanced_text) == want


def test_aliases_and_mentions(spark):
    assert one(spark, "Sammy Davis Jr", text.alias_keys) == ["sammy davis jr", "sammy davis"]
    assert one(spark, "Bob Ii", text.alias_keys) == ["bob ii", "bob"]
    ask = lambda name: lambda c: text.contains_mention(c, F.lit(name))
    assert one(spark, "who directed The Old Fort", ask("Old Fort")) is True
    assert one(spark, "who directed it", ask("")) is False


ROWS = [
    ("d1", "s1", 0, 0, "RELATION", "Film A", "director", "Maung Wunna", ""),
    ("d1", "s1", 0, 1, "RELATION", "Maung Wunna", "won", "Prize", "Film facts"),
    ("d1", "s1", 0, 2, "ATTRIBUTE", "Film A", "year", "1999", "Film facts"),
    ("d2", "s2", 1, 0, "relation", " film a ", "Director", "Maung  Wunna", "Film facts"),
    ("d2", "s2", 1, 1, "OTHER", "x", "y", "z", ""),
    ("d2", "s2", 1, 2, "RELATION", "", "y", "z", ""),
]


@pytest.fixture(scope="module")
def toy(spark):
    raw = spark.createDataFrame(ROWS, "dataset_id string, sample_id string, source_index long, triple_index int, triple_type string, subject string, predicate string, object string, title string")
    return store.Store(raw)


def test_store(toy):
    assert [(r.node_id, r.canonical_name, r.kind) for r in toy.nodes.orderBy("node_id").collect()] == [(1, "Film A", "entity"), (2, "Maung Wunna", "entity"), (3, "Prize", "literal"), (4, "1999", "literal")]
    triples = toy.triples.orderBy("triple_id").collect()
    assert [(t.triple_id, t.subject_id, t.predicate, t.object_id, t.object_kind) for t in triples] == [(1, 1, "director", 2, "entity"), (2, 2, "won", 3, "literal"), (3, 1, "year", 4, "literal")]
    assert toy.triple_sources.count() == 4
    assert toy.kv_records.agg(F.min("kv_offset"), F.max("kv_offset"), F.count("*")).first() == (0, 5, 6)
    assert {r.triple_id: r.title for r in store.hydrated(toy).collect()} == {1: "Film facts", 2: "Film facts", 3: "Film facts"}


def test_expansion(spark, toy):
    seeds = spark.createDataFrame([(7, 1)], "qid long, node_id long")
    entities = toy.nodes.where("kind = 'entity'").select("node_id")
    nodes, triples = graph.k_hop(seeds, store.incidence(toy.triples), 2, entities)
    assert sorted(r.triple_id for r in triples.collect()) == [1, 2, 3]
    assert {r.node_id: r.depth for r in nodes.collect()} == {1: 0, 2: 1, 4: 1, 3: 2}
    assert graph.k_hop(seeds, store.incidence(toy.triples), 0)[1].count() == 0
    assert store.incidence(toy.triples, 1).count() == 2


def test_components(spark):
    chain = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 100), (5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 101: 100}


def test_layers_and_reach(spark):
    e = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 1, 3), (2, 5, 6), (2, 6, 5)], "qid long, src long, dst long")
    assert {(r.qid, r.node): r.layer for r in graph.topological_layers(e).collect()} == {(1, 1): 0, (1, 2): 1, (1, 3): 2}
    start = spark.createDataFrame([(1, 2), (2, 5)], "qid long, node long")
    assert {(r.qid, r.node) for r in graph.reachable(start, e).collect()} == {(1, 2), (1, 3), (2, 5), (2, 6)}


def test_top_k(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [5.0, 0.0]), (4, [0.0, 0.0])], "node_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [2.0, 0.1])], "qid long, vector array<float>")
    assert [r.node_id for r in search.top_k(q, v, 2).orderBy("rank").collect()] == [1, 3]
    assert search.top_k(q, v, 0).count() == 0


def test_answers(spark):
    df = spark.createDataFrame([("The cat, sat!", "the cat sat"), ("", ""), ("a", ""), ("a a b", "a b b")], "p string, g string")
    assert [r[0] for r in df.select(metrics.token_f1("p", "g")).collect()] == pytest.approx([1, 1, 0, 2 / 3])
    assert [r[0] for r in df.select(metrics.rouge_l(metrics.words("p"), metrics.words("g"))).collect()] == pytest.approx([1, 0, 0, 2 / 3])


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": [{"id": 1}, {"id": 2}]}')
    (tmp_path / "b.json").write_text('{"id": 1}\n\n{"id": 2}\n')
    (tmp_path / "c.json").write_text('{\n "id": 1\n}\n{"id": 2}\n[{"id": 3}]')
    assert files.read_json(spark, str(tmp_path / "a.json")).count() == 2
    assert files.read_json(spark, str(tmp_path / "b.json")).count() == 2
    assert sorted(r.id for r in files.read_concatenated(spark, str(tmp_path / "c.json"), "id long").collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="missing columns: nope"):
        spark.createDataFrame([(1,)], "x int").write.parquet(str(tmp_path / "p"))
        files.parquet_preview(spark, str(tmp_path / "p"), ["nope"], 1)


def test_steps_run_by_question(spark):
    """Topics may be derived from the edges themselves, and a question may have none."""
    from lattica.operators import selection

    e = spark.createDataFrame([(1, 0, 1, 2, 0.9), (1, 1, 2, 1, 0.4), (2, 0, 5, 6, 0.3)], "qid long, eid long, src long, dst long, score double")
    topics = e.where("qid = 1").groupBy("qid").agg(F.min("src").alias("node"))
    kept = selection.per_question(e, topics, lambda own, _: selection.without_cycles(own))
    assert sorted((r.qid, r.eid) for r in kept.collect()) == [(1, 0), (2, 0)]
    built = selection.per_question(e, topics, lambda own, t: selection.limit_terminals(own, t, 1))
    assert {r.qid for r in built.collect()} <= {1}
