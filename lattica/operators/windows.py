"""Running computations over a whole table, without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.session import cut


def in_order(df: DataFrame, by: list[str]) -> DataFrame:
    """The rows with ``_part`` and ``_n``: range partitions in the order of ``by``, and each row's place in its partition from 0.

    Written once (``cut``): everything read from the result agrees on which row is
    in which partition. Computed twice, the partitions differ, as a second reading
    samples its bounds anew and may be coalesced otherwise.
    """
    place = F.monotonically_increasing_id()
    laid = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_place", place))
    return laid.withColumns({"_part": F.shiftright("_place", 33), "_n": F.col("_place").bitwiseAND((1 << 33) - 1)}).drop("_place")


def _before(sizes: DataFrame) -> DataFrame:
    """_part and what the partitions before it hold together; one row for each partition."""
    rows = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sizes.select("_part", F.coalesce(F.sum("_size").over(rows), F.lit(0)).alias("_before")))


def numbered(df: DataFrame, by: list[str], name: str, start: int = 1) -> DataFrame:
    """Add the row's rank in the order of ``by`` (unique together), counting from ``start``."""
    laid = in_order(df, by)
    sizes = laid.groupBy("_part").agg((F.max("_n") + 1).alias("_size"))
    return laid.join(_before(sizes), "_part").withColumn(name, (F.col("_before") + F.col("_n") + start).cast("long")).drop("_part", "_n", "_before")


def exclusive_offsets(df: DataFrame, order: str, size: str, name: str) -> DataFrame:
    """Add the sum of ``size`` over all rows before, in order of ``order`` (unique).

    Rows are range-partitioned; each partition sums its own rows, and the
    partitions' totals, a row for each, are summed apart. A null size counts 0.
    """
    laid = in_order(df, [order])
    own = Window.partitionBy("_part").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    local = laid.withColumn("_own", F.coalesce(F.sum(size).over(own), F.lit(0)))
    totals = laid.groupBy("_part").agg(F.coalesce(F.sum(size), F.lit(0)).alias("_size"))
    return local.join(_before(totals), "_part").withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_n", "_own", "_before")


def running_parts(df: DataFrame, order: str, mark: str) -> DataFrame:
    """Add part: how many marked rows there are up to and with each row."""
    counted = exclusive_offsets(df.withColumn("_m", F.col(mark).cast("int")), order, "_m", "_before_row")
    return counted.withColumn("part", F.col("_before_row") + F.col("_m")).drop("_m", "_before_row")


def merge_tail(buckets: DataFrame, bucket: str, size: str, least: int) -> DataFrame:
    """From the first bucket smaller than ``least`` on, all buckets become one, -1. The table of buckets is small."""
    small = F.max((F.col(size) < least).cast("int")).over(Window.orderBy(bucket))
    return buckets.withColumn(bucket, F.when(small == 1, -1).otherwise(F.col(bucket)).cast("long")).groupBy(bucket).agg(F.sum(size).alias(size))
