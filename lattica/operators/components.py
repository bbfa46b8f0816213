"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.session import discard, saved


def _by_first(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct pairs (u, v) dealt by u, and the smallest v of each u; one exchange serves both and whatever is joined on u."""
    dealt = pairs.select("u", "v").repartition("u").distinct()
    return dealt, dealt.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is the smallest node reachable.

    Edges with a null end and loops are left out, so a node without a proper edge
    isn't in the result. A round has two exchanges: the large star hangs the larger
    neighbours of a node on the smallest node around it, the small star the smaller
    ones; it marks the pairs that moved. The edge list shrinks to one star for each
    component; each star's pairs are written to the checkpoint folder, in place of those
    they come from, so that one exchange is on disk at a time.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    e = saved(e.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") > F.col("v"))), "stars")
    for _ in range(max_rounds):
        around, low = _by_first(e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        # node u with its smallest neighbour m, or itself: larger neighbours v hang on it, and so does u
        met = around.join(low, "u").withColumn("m", F.least("u", "m"))
        hung = F.array(F.when(F.col("v") > F.col("u"), F.struct(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") < F.col("u")).alias("moved"))), F.when(F.col("m") < F.col("u"), F.struct("u", F.col("m").alias("v"), F.lit(False).alias("moved"))))
        large = saved(met.select(F.explode(F.array_compact(hung)).alias("x")).select("x.*"), "stars")
        discard(e)
        moved = large.repartition("u").groupBy("u", "v").agg(F.max("moved").alias("moved"))
        least = moved.groupBy("u").agg(F.min("v").alias("m"))
        joined = moved.join(least, "u")
        hung = F.array(F.when(F.col("v") > F.col("m"), F.struct(F.col("v").alias("u"), F.col("m").alias("v"), F.lit(True).alias("moved"))), F.when(F.col("v") == F.col("m"), F.struct("u", "v", "moved")), F.when(F.col("v") > F.col("m"), F.struct("u", F.col("m").alias("v"), F.lit(True).alias("moved"))))
        e = saved(joined.select(F.explode(F.array_compact(hung)).alias("x")).select("x.*"), "stars")
        discard(large)
        if e.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    stars = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))).alias("x")).select("x.*")
    return stars.distinct()
