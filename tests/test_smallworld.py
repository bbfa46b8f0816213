"""Small-world search against the exact one; the index is read as it lies."""

import numpy as np
from pyspark.sql import functions as F

from lattica.operators import ann, smallworld
from lattica.operators.search import top_k


def vectors(spark, n, clusters, seed=4, width=24, spread=0.4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(clusters, width))
    rows = [(k, (middle[k % clusters] + spread * rng.normal(size=width)).tolist()) for k in range(n)]
    return spark.createDataFrame(rows, "node_id long, embedding array<double>")


def asked(v):
    return v.where("node_id % 50 = 0").select(F.col("node_id").alias("qid"), F.col("embedding").alias("vector"))


def test_recall_over_shards_and_clusters(spark, tmp_path):
    for clusters, spread in ((1, 1.0), (40, 0.2)):
        v = vectors(spark, 2400, clusters, spread=spread)
        index = smallworld.SmallWorld.build_at(v, str(tmp_path / f"i{clusters}"), shard_rows=900)
        assert index.rows.agg(F.sum("size"), F.count("*")).first() == (2400, 3)
        exact, found = top_k(asked(v), v, 10), index.search(asked(v), 10)
        assert found.count() == exact.count()
        assert ann.recall(exact, found).agg(F.avg("recall")).first()[0] >= 0.95
        assert found.where("qid = node_id and rank = 1").count() == asked(v).count()


def test_a_second_search_reads_the_index(spark, tmp_path):
    v = vectors(spark, 300, 3)
    path = str(tmp_path / "i")
    first = smallworld.SmallWorld.build_at(v, path).search(asked(v), 3).collect()
    again = smallworld.SmallWorld(spark, path)
    plan = again.rows._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "Exchange" not in plan
    assert sorted(again.search(asked(v), 3).collect()) == sorted(first)


def test_odd_tables(spark, tmp_path):
    v = vectors(spark, 5, 2)
    odd = v.union(spark.createDataFrame([(7, None), (8, [0.0] * 24), (None, [1.0] * 24), (1, [1.0] * 24)], v.schema))
    index = smallworld.SmallWorld.build_at(odd, str(tmp_path / "odd"))
    assert index.rows.agg(F.sum("size")).first()[0] == 7
    found = index.search(asked(v), 20).collect()
    assert sorted(r.node_id for r in found) == [0, 1, 1, 2, 3, 4, 8]
    assert index.search(asked(v), 0).count() == 0 and index.search(asked(v).where("false"), 3).count() == 0
    assert index.search(spark.createDataFrame([(1, None)], "qid long, vector array<double>"), 3).count() == 0
    empty = smallworld.SmallWorld.build_at(v.where("false"), str(tmp_path / "none"))
    assert empty.search(asked(v), 3).count() == 0


def test_layers_thin_out():
    levels = smallworld.layers(np.arange(20_000))
    assert abs((levels >= 1).mean() - 1 / 16) < 0.01 and (levels >= 2).mean() < 0.01
