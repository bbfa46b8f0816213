"""Approximate search against the exact one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import ann
from lattica.operators.search import top_k


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(20, 16))
    rows = [(k, (middle[k % 20] + 0.4 * rng.normal(size=16)).tolist()) for k in range(1500)]
    rows += [(2000, [0.0] * 16), (2001, None)]
    vectors = spark.createDataFrame(rows, "node_id long, embedding array<double>")
    asked = vectors.where("node_id % 50 = 0 and node_id < 1500").select(F.col("node_id").alias("qid"), F.col("embedding").alias("vector"))
    return asked, vectors


def test_recall_of_lists(clustered):
    asked, vectors = clustered
    usable = vectors.where("embedding is not null")
    exact = top_k(asked, usable, 10)
    found = ann.search(asked, usable, 10, "lists")
    assert ann.recall(exact, found).agg(F.avg("recall")).first()[0] >= 0.9
    assert found.where("qid = node_id and rank = 1").count() == asked.count()


def test_every_vector_is_in_a_list_and_all_lists_are_exact(clustered):
    asked, vectors = clustered
    index = ann.Index(vectors)
    assert sorted(r.node_id for r in index.rows.collect()) == [*range(1500), 2000, 2001]
    exact = {(r.qid, r.rank): r.node_id for r in top_k(asked, vectors.where("embedding is not null"), 5).collect()}
    found = {(r.qid, r.rank): r.node_id for r in ann.Index(vectors.where("embedding is not null")).search(asked, 5, ann.MOST_LISTS).collect()}
    assert found == exact


def test_backends(spark, clustered):
    asked, vectors = clustered
    usable = vectors.where("embedding is not null")
    assert ann.search(asked, usable, 0, "lists").count() == 0
    assert ann.search(asked, usable.where("false"), 5, "lists").count() == 0
    assert ann.search(asked, usable, 3).count() == 3 * asked.count()
    with pytest.raises(ValueError, match="no backend"):
        ann.search(asked, usable, 3, "other")
