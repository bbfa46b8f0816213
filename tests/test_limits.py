"""Nothing stops at a number of rounds, words or rows."""

from lattica.operators import ann, graph, search


def test_long_ways(spark):
    n = 130
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(n)], "qid long, src long, dst long")
    start = spark.createDataFrame([(1, n - 3)], "qid long, node long")
    assert graph.reachable(start, edges).count() == 4


def test_long_names_are_mentioned(spark):
    name = "the very long name of an old order of eleven words"
    aliases = spark.createDataFrame([(name, 5), ("old", 6), ("an old order", 7)], "alias_key string, node_id long")
    asked = spark.createDataFrame([(1, f"Who founded {name.title()}, then?"), (2, ""), (3, None)], "qid long, text string")
    assert {(r.qid, r.node_id) for r in search.mentions(asked, aliases).collect()} == {(1, 5), (1, 7)}
    assert search.mentions(asked, aliases.where("false")).count() == 0


def test_auto_goes_by_the_index(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "node_id long, embedding array<double>")
    asked = vectors.where("node_id < 3").selectExpr("node_id as qid", "embedding as vector")
    exact = search.top_k(asked, vectors, 4).collect()
    assert sorted(ann.search(asked, vectors, 4).collect()) == sorted(exact)
    index = ann.Index(vectors, lists=4)
    one = sorted(index.search(asked, 4, probes=1).collect())
    assert sorted(ann.search(asked, vectors, 4, probes=1, index=index).collect()) == one
