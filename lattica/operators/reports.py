"""Aggregates of reports: percentiles by nearest rank, upserts, folds, placement counters, trace statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(df: DataFrame, value: str, by: list[str], percents: tuple[int, ...]) -> DataFrame:
    """The values at places round(p / 100 * (n - 1)) of each group's sorted values, halves to even.

    The rows are ranked, not collected, so a group may be of any size.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    n = df.where(F.col(value).isNotNull()).withColumns({"_n": F.count("*").over(group), "_i": F.row_number().over(group.orderBy(value)) - 1})
    at = lambda p: F.bround(F.lit(p / 100) * (F.col("_n") - 1))
    return n.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == at(p), F.col(value))).alias(f"p{p}") for p in percents])


def latest_non_empty(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row for each key: the last value by ``order`` that isn't empty, else the empty text."""
    held = F.when(F.coalesce(F.col(value), F.lit("")) != "", F.col(order))
    return df.groupBy(key).agg(F.coalesce(F.max_by(F.when(held.isNotNull(), F.col(value)), held), F.lit("")).alias(value))


def best_of(df: DataFrame, key: str, quality: list[str], tie: str) -> DataFrame:
    """The row of highest quality of each key; the quality's columns are compared in order, ties go to the lowest ``tie``."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(q) for q in quality], tie))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def ordered_union(parts: list[DataFrame], key: list[str], order: list[str]) -> DataFrame:
    """Rows of several tables (equal columns), each key from the first table that has it; ``part`` says which."""
    every = None
    for i, part in enumerate(parts):
        tagged = part.withColumn("part", F.lit(i))
        every = tagged if every is None else every.unionByName(tagged)
    return keep_first(every, key, ["part", *order])


def content_key(df: DataFrame, leave_out: list[str]) -> Column:
    """MD5 of a row's columns as compact JSON in order of their names, those left out apart."""
    rest = sorted(c for c in df.columns if c not in leave_out)
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in rest]), {"ignoreNullFields": "false"}))


def fold_tails(df: DataFrame, key: list[str], tail: str, order: str, most: int = 50) -> DataFrame:
    """One tail for each key, folded in order: of two of which one holds the other the longer; two shorter than ``most`` as
    their distinct parts between commas, sorted; else the first. A key has as many tails as a head has objects of one relation."""
    tails = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(tail).alias("t")))), lambda x: x["t"])

    def step(a: Column, b: Column) -> Column:
        parts = F.filter(F.transform(F.split(F.concat(a, F.lit(","), b), ","), lambda x: F.trim(x)), lambda x: x != "")
        joined = F.array_join(F.array_sort(F.array_distinct(parts)), ", ")
        return F.when(F.contains(b, a), b).when(F.contains(a, b), a).when((F.length(a) < most) & (F.length(b) < most), joined).otherwise(a)

    return df.groupBy(*key).agg(tails.alias("_t")).select(*key, F.aggregate(F.slice("_t", 2, F.greatest(F.size("_t") - 1, F.lit(0))), F.get("_t", 0), step).alias(tail))


def rate(condition: Column) -> Column:
    """The share of rows that meet a condition; a null one counts as not met."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def trace_stats(trace: DataFrame, by: list[str], before: str, after: str, floor: float = 1e-12) -> DataFrame:
    """sum, max and entropy of two weightings of the same items, and the divergence of the second from the first (natural log)."""
    share = lambda c: F.greatest(F.col(c) / F.greatest(F.sum(c).over(Window.partitionBy(*by)), F.lit(floor)), F.lit(floor))
    s = trace.withColumns({"_p": share(before), "_q": share(after)})
    entropy = lambda c: -F.sum(F.col(c) * F.log(c))
    return s.groupBy(*by).agg(F.sum(before).alias("sum_before"), F.sum(after).alias("sum_after"), F.max(before).alias("max_before"), F.max(after).alias("max_after"), entropy("_p").alias("entropy_before"), entropy("_q").alias("entropy_after"), F.sum(F.col("_q") * F.log(F.col("_q") / F.col("_p"))).alias("divergence"))


def sink_ranks(sinks: DataFrame) -> DataFrame:
    """Sinks (qid, eid, score, is_answer) with their rank by score, then eid; and best, the rank of the question's first answer."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "eid"))
    return sinks.withColumn("rank", rank).withColumn("best", F.min(F.when(F.col("is_answer"), F.col("rank"))).over(Window.partitionBy("qid")))


def hit_curve(ranked: DataFrame) -> DataFrame:
    """k, hits and questions: of the questions with k sinks or more, those with an answer among the first k."""
    per = ranked.groupBy("qid").agg(F.max("rank").alias("n"), F.min("best").alias("best"))
    each = per.select("best", F.explode(F.sequence(F.lit(1), "n")).alias("k"))
    return each.groupBy("k").agg(count_where(F.col("best") <= F.col("k")).alias("hits"), F.count("*").alias("questions"))


def level_prizes(scored: DataFrame, by: list[str], score: str, levels: int, decay: float = 0.01) -> DataFrame:
    """Add prize: rows of one score share a level. Of the best K = ``levels`` levels (fewer if there are fewer) the k-th gives its
    rows (K - k) / rows each, k from 0, but no more than the level before, shrunk by ``decay``; other rows get 0.
    Levels are folded as one array of at most K for each group."""
    at = scored.withColumn("_level", F.dense_rank().over(Window.partitionBy(*by).orderBy(F.desc(score))))
    counts = at.where(F.col("_level") <= levels).groupBy(*by, "_level").agg(F.count("*").alias("n"))
    arrays = counts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_level", "n"))), lambda x: x["n"]).alias("n"))
    start = F.struct(F.size("n").cast("double").alias("mass"), F.size("n").cast("double").alias("most"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        prize = F.least(acc["mass"] / n, acc["most"])
        return F.struct((acc["mass"] - 1).alias("mass"), (prize * (1 - decay)).alias("most"), F.concat(acc["out"], F.array(prize)).alias("out"))

    folded = arrays.select(*by, F.aggregate("n", start, step, lambda acc: acc["out"]).alias("prizes"))
    return at.join(folded, by).select(*scored.columns, F.coalesce(F.get("prizes", F.col("_level") - 1), F.lit(0.0)).alias("prize"))


def rollovers(df: DataFrame, by: list[str], order: list[str], clock: str) -> DataFrame:
    """Add day: how often the clock has gone back up to each row of its group."""
    w = Window.partitionBy(*by).orderBy(*order)
    back = (F.col(clock) < F.lag(clock).over(w)).cast("int")
    return df.withColumn("_b", F.coalesce(back, F.lit(0))).withColumn("day", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")
