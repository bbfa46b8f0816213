"""The exact search by matrices against plain Python, odd vectors included."""

import math
import random

from lattica.operators import retrieval, search


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    size = lambda v: max(math.sqrt(sum(x * x for x in v)), 1e-12)
    return sum(x / size(a) * (y / size(b)) for x, y in zip(a, b, strict=True))


def test_all_vectors_are_ranked(spark):
    draw = random.Random(5)
    vectors = [(i, [float(draw.randrange(-2, 3)) for _ in range(4)]) for i in range(300)]
    vectors += [(300, None), (301, [1.0]), (302, [1.0, None, 0.0, 0.0]), (303, [0.0] * 4), (304, [1e200, 0.0, 0.0, 0.0])]
    asked = [*vectors[:20], (300, None), (301, [1.0])]
    v, q = spark.createDataFrame(vectors, "node_id long, embedding array<double>").repartition(3), spark.createDataFrame(asked, "qid long, vector array<double>")
    for k in (3, 303):
        got = {}
        for r in search.top_k(q, v, k).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append((r.node_id, None if r.score is None else round(r.score, 9)))
        for qid, vector in asked:
            scores = [(i, cosine(vector, e)) for i, e in vectors if i != 304]
            want = sorted(((s is None, -round(s or 0, 9), i) for i, s in scores), key=lambda t: (t[0], t[1] + 0.0, t[2]))
            have = [i for i, _ in got[qid] if i != 304]
            scored = {i: s and round(s, 9) for i, s in scores}
            assert [scored[i] for i in have] == [scored[i] for _, _, i in want][: len(have)] and len(got[qid]) == min(k, 305)


def test_no_pair_is_scored_row_by_row(spark):
    v = spark.range(100).selectExpr("id as node_id", "array(cast(id as double), 1d) as embedding")
    plan = search.top_k(v.where("node_id % 50 = 0").selectExpr("node_id as qid", "embedding as vector"), v, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def test_queries_look_into_their_lists_only(spark):
    draw = random.Random(6)
    rows = [(i, [draw.gauss(0, 1) for _ in range(3)], i % 4) for i in range(200)] + [(200, [1.0], 1), (201, None, 2)]
    v = spark.createDataFrame(rows, "node_id long, embedding array<double>, list int").repartition(3)
    asked = [("a", rows[0][1], [1]), ("b", rows[1][1], [2, 3]), ("c", rows[2][1], []), ("d", rows[3][1], [9])]
    got = {}
    for r in search.nearest(spark.createDataFrame(asked, "qid string, vector array<double>, _l array<int>"), v, 5).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.node_id)
    want = {q: [i for _, i in sorted((-cosine(vector, e), i) for i, e, at in rows if at in lists and cosine(vector, e) is not None)][:5] for q, vector, lists in asked}
    assert got == {q: w for q, w in want.items() if w}


def test_classes_of_near_chains_stand_for_all_pairs(spark):
    draw = random.Random(9)
    word = lambda: draw.choice(("Kenya", "KENYA", "the Kenya", "Ken", "of Kenya", "ab", "China", "kenyan", "Chi"))
    rows = [(q, e, word(), word()) for q in range(12) for e in range(1, draw.randrange(2, 9))] + [(99, 1, "Kenya", "KENYA"), (99, 2, "xx", "yy")]
    t = spark.createDataFrame(rows, "qid long, eid long, subject string, object string")
    got = retrieval.near_chain_classes(t, "qid").collect()
    held = {}
    for qid, part, i, j in got:
        held.setdefault((qid, part, i), []).append(j)
    pairs = {(q, a, b) for q, part, i, j in got if part == "pair" for a in held[q, "object", i] for b in held[q, "subject", j] if a != b}
    assert pairs == {tuple(r) for r in retrieval.near_chains(t, "qid").collect()}
    # each class is there once, and a triple's own texts alone are no pair
    assert len({tuple(r) for r in got}) == len(got) and not any(r[0] == 99 and r[1] == "pair" for r in got)


def test_near_chains_are_pairs_of_triples_however_many_share_a_text(spark):
    from lattica.plans import all_oracles

    draw = random.Random(10)
    word = lambda: draw.choice(("Kenya", "KENYA", "the Kenya", "Ken", "of Kenya", "ab", "China", "kenyan", "Chi"))
    rows = [(q, e, word(), word()) for q in range(4) for e in range(1, 40)] + [(99, 1, "Kenya", "KENYA"), (99, 2, "xx", "yy")]
    t = spark.createDataFrame(rows, "qid long, eid long, subject string, object string")
    near = lambda a, b: len(a) >= 3 and len(b) >= 3 and (a.lower() in b.lower() or b.lower() in a.lower())
    want = sorted((q, i, j) for q, i, _, o in rows for r, j, s, _ in rows if q == r and i != j and near(o, s))
    assert sorted(tuple(r) for r in retrieval.near_chains(t, "qid", many=3).collect()) == want
    assert "part" not in all_oracles()["j8_near_chains"]  # a row for each pair of triples


def test_audits_count_what_lies_within_each_hop_without_listing_it(spark):
    draw = random.Random(11)
    kinds = ("RELATION", "RELATION", "ATTRIBUTE")
    triples = [(i, draw.choice(kinds), draw.randrange(14), draw.randrange(14), draw.choice(("entity", "entity", "literal"))) for i in range(40)]
    links = sorted({(i, draw.choice((i * 2, i * 2 + 1, 500 + i % 5))) for i in range(40) for _ in range(2)})
    seeds = [(q, draw.randrange(14)) for q in range(5)] + [(2, 3), (9, 99)]
    got = retrieval.audit_expansion(
        spark.createDataFrame(seeds, "qid long, node_id long"), spark.createDataFrame(triples, "triple_id long, triple_type string, subject_id long, object_id long, object_kind string"), spark.createDataFrame(links, "triple_id long, kv_offset long"), 2
    )
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    related = [(i, a, b) for i, kind, a, b, o in triples if kind == "RELATION" and o == "entity"]
    want = set()
    for q in {q for q, _ in seeds}:
        at = {n for p, n in seeds if p == q}
        for hop in range(3):
            inside = {i for i, _, a, _, _ in triples if a in at} | {i for i, _, b in related if b in at}
            want.add((q, hop, len(at), len(inside), len({k for i, k in links if i in inside})))
            at = at | {b for _, a, b in related if a in at} | {a for _, a, b in related if b in at}
    assert {tuple(r) for r in got.collect()} == want
    # triples of a neighbourhood aren't told apart by their ids
    assert "Aggregate [qid" in plan and not any("Aggregate [qid" in line and "triple_id" in line for line in plan.splitlines())
