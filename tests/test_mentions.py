"""j22_mentions finds the names that its first SQL asked for."""

from types import SimpleNamespace

from lattica.plans import store_queries


def test_short_names_are_mentioned(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "IRAN")], "n_nationkey long, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    names = spark.createDataFrame([("iran", 1), ("part 12", 2), ("of", 3), ("part 1", 4)], "alias_key string, node_id long")
    monkeypatch.setattr(store_queries, "built", lambda *_: SimpleNamespace(aliases=names))
    assert {(r.qid, r.alias_key) for r in store_queries.mentions(spark, str(tmp_path)).collect()} == {(1, "iran"), (1, "part 12")}
