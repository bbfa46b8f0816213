"""Numbering and running sums over many partitions, wide rows and skew, with adaptive execution on and off."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.operators.windows import exclusive_offsets, numbered, running_parts


@pytest.fixture(params=["true", "false"])
def adaptive(request, spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.fixture
def rows(spark):
    """20,000 wide rows with skewed sizes, in no order, over 23 partitions."""
    rng = random.Random(5)
    keys = rng.sample(range(10**6), 20_000)
    data = [(k, k // 300_000, rng.choice([0, 1, 1, 2, 5000]), "x" * (k % 97)) for k in keys]
    return data, spark.createDataFrame(data, "k long, g long, size long, wide string").repartition(23)


def test_numbered(rows, adaptive):
    data, df = rows
    got = {r.k: (r.n, r.wide) for r in numbered(df, ["g", "k"], "n", 3).collect()}
    assert got == {k: (i, wide) for i, (k, _, _, wide) in enumerate(sorted(data), 3)}


def test_exclusive_offsets(rows, adaptive):
    data, df = rows
    got = {r.k: r.at for r in exclusive_offsets(df, "k", "size", "at").collect()}
    total, want = 0, {}
    for k, _, size, _ in sorted(data):
        want[k], total = total, total + size
    assert got == want


def test_running_parts(rows, adaptive):
    data, df = rows
    got = {r.k: r.part for r in running_parts(df.withColumn("mark", F.col("size") > 2), "k", "mark").collect()}
    n, want = 0, {}
    for k, _, size, _ in sorted(data):
        n += size > 2
        want[k] = n
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "k long, size long")
    assert numbered(df, ["k"], "n").collect() == []
    assert exclusive_offsets(df, "k", "size", "at").collect() == []
