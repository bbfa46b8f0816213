"""Peak concurrency: how many intervals are open at each moment, and how much they weigh.

Time is cut into buckets. Each interval is clipped to every bucket it overlaps, so
a bucket holds all that is open in it and is swept for itself, with no count
carried over from the bucket before. The piece that an interval leaves in a later
bucket opens at the bucket's border: an artificial change, which counts but makes
no row. The buckets' rows are then stitched: a row's successor and the maxima
before it come from a table of one row for each key and bucket.

Pieces that open at a border are summed by key, first and last bucket before they
are replicated, so replication follows buckets, not rows; real changes are summed
by key and moment before they meet in a bucket, so a bucket of a hot key has at
most as many rows as it has moments. Everything is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from lattica.llm.columns import needed
from lattica.session import saved

DAY = 86_400
#: More buckets than this are never made: the width doubles until those with a change are fewer.
MAX_BUCKETS = 4_096
#: Nations of the contract: sales of all clients, and of clients without a nation.
EVERY, UNKNOWN = -2, -1


def seconds(df: DataFrame, name: str) -> Column:
    """Whole UTC seconds since 1970, rounded down; a timestamp without a zone is read as UTC, whatever the session's zone."""
    if name in df.columns and isinstance(df.schema[name].dataType, TimestampNTZType):
        t = F.col(f"`{name}`")
        return F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * DAY + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    return F.unix_seconds(F.col(f"`{name}`").cast("timestamp")) if name in df.columns else F.lit(None).cast("long")


def sale_intervals(sales: DataFrame, lines: DataFrame, clients: DataFrame, extra_days: int = 1) -> DataFrame:
    """(key int, start long, end long, weight long) of each sale that takes part.

    Open from sold_at until the sale's earliest known shipped_at plus
    ``extra_days``, with a null end (for ever) where there is none. key is the
    nation of the sale's client, -1 for none; weight is the total in cents, 0 for
    null. Sales with a null sold_at or an end not after the start are left out;
    repeated sales count each. A client listed more than once has the smallest of
    its nations. A sale without an id has no lines, one without a client no nation.
    Ends and nations are summed up and written before they are joined: a join of
    plain exchanges is one whose hot keys Spark splits.
    """
    opened = needed(sales.withColumn("_start", seconds(sales, "sold_at")), sale_id="long", client_id="long", total="double", _start="long").where(F.col("_start").isNotNull())
    shipped = needed(lines.withColumn("_ship", seconds(lines, "shipped_at")), sale_id="long", _ship="long").where(F.col("sale_id").isNotNull() & F.col("_ship").isNotNull())
    closed = shipped.groupBy("sale_id").agg((F.min("_ship") + extra_days * DAY).alias("end"))
    closed = saved(closed, "closed")
    nations = needed(clients, client_id="long", nation_id="int").where(F.col("client_id").isNotNull()).groupBy("client_id").agg(F.min("nation_id").alias("key"))
    nations = saved(nations, "nations")
    timed = opened.join(closed, "sale_id", "left").where(F.col("end").isNull() | (F.col("end") > F.col("_start")))
    cents = F.coalesce(F.floor(100 * F.col("total") + 0.5), F.lit(0)).cast("long")
    return timed.join(nations, "client_id", "left").select(F.coalesce("key", F.lit(UNKNOWN)).cast("int").alias("key"), F.col("_start").alias("start"), "end", cents.alias("weight"))


def _occupied(intervals: DataFrame, width: int, most: int) -> tuple[int, list[int]]:
    """A width, and the numbers of the buckets in which something starts or ends: at most ``most`` of them."""
    while True:
        numbers = intervals.select(F.explode(F.array_compact(F.array(F.floor(F.col("start") / width), F.floor(F.col("end") / width)))).alias("b")).distinct()
        found = [int(r.b) for r in numbers.limit(most + 1).collect()]
        if len(found) <= most:
            return width, sorted(found)
        width *= 2


def concurrency(intervals: DataFrame, width: int = DAY, every: int | None = EVERY, max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """Moments at which what is open changes, for each key: key, from_s, to_s, n_open, open_weight, high_open, is_peak.

    ``intervals`` has key, start, end (excluded; null: for ever) and weight. A row
    stands at each moment whose starts and ends together change the number or the
    weight of the open intervals; where they cancel out there is none. to_s is the
    key's next such moment, null for its last; high_open the largest n_open up to
    here; is_peak tells whether open_weight is the key's largest. ``every`` is a
    further key for all intervals together. Intervals with a null start or an end
    not after it are left out, a null weight counts 0. No intervals give no rows.

    A bucket is ``width`` seconds wide, and so has at most as many moments; buckets
    without a change aren't made. The only thing sent to the driver is the list of
    at most ``max_buckets`` bucket numbers.
    """
    rows = needed(intervals, key="int", start="long", end="long", weight="long").where(F.col("start").isNotNull() & (F.col("end").isNull() | (F.col("end") > F.col("start"))))
    rows = saved(rows.select("key", "start", "end", F.coalesce("weight", F.lit(0)).alias("weight")), "intervals")
    width, numbers = _occupied(rows, width, max_buckets)
    bucket = lambda t: F.floor(F.col(t) / width).cast("long")
    keyed = rows if every is None else rows.select(F.explode(F.array("key", F.lit(every))).alias("key"), "start", "end", "weight")

    change = lambda t, sign: F.struct(F.col(t).alias("t"), F.lit(sign).alias("n"), (F.lit(sign) * F.col("weight")).alias("w"))
    changes = keyed.select("key", F.explode(F.array(change("start", 1), change("end", -1))).alias("x")).where("x.t IS NOT NULL")
    real = changes.groupBy("key", "x.t").agg(F.sum("x.n").cast("long").alias("n"), F.sum("x.w").alias("w"))

    spans = keyed.groupBy("key", bucket("start").alias("first"), bucket("end").alias("last")).agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    known = F.array(*[F.lit(b).cast("long") for b in numbers]) if numbers else F.array().cast("array<bigint>")
    place = lambda c: F.array_position(known, F.col(c))
    later = F.slice(known, place("first") + 1, F.coalesce(place("last"), F.lit(len(numbers))) - place("first"))
    pieces = spans.select("key", F.explode(later).alias("b"), "n", "w").groupBy("key", "b").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))

    none = F.lit(0).cast("long")
    held = real.select("key", bucket("t").alias("b"), "t", "n", "w", none.alias("at_n"), none.alias("at_w"))
    held = held.unionByName(pieces.select("key", "b", (F.col("b") * width).alias("t"), none.alias("n"), none.alias("w"), F.col("n").alias("at_n"), F.col("w").alias("at_w")))
    # a border and a real change at one moment: the border's row comes first, so the row of the real change has both
    within = Window.partitionBy("key", "b").orderBy("t", F.col("at_n").desc()).rowsBetween(Window.unboundedPreceding, 0)
    swept = held.select("key", "b", "t", "n", "w", F.sum(F.col("n") + F.col("at_n")).over(within).alias("n_open"), F.sum(F.col("w") + F.col("at_w")).over(within).alias("open_weight"))
    swept = swept.where((F.col("n") != 0) | (F.col("w") != 0))
    order = Window.partitionBy("key", "b").orderBy("t")
    swept = swept.select("key", "b", "t", "n_open", "open_weight", F.lead("t").over(order).alias("next"), F.max("n_open").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("high"))

    buckets = swept.groupBy("key", "b").agg(F.min("t").alias("first_t"), F.max("n_open").alias("most"), F.max("open_weight").alias("weight"))
    by_key = Window.partitionBy("key").orderBy("b")
    stitched = buckets.select("key", "b", F.lead("first_t").over(by_key).alias("after"), F.max("most").over(by_key.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.max("weight").over(Window.partitionBy("key")).alias("peak"))
    return swept.join(stitched, ["key", "b"]).select("key", F.col("t").alias("from_s"), F.coalesce("next", "after").alias("to_s"), "n_open", "open_weight", F.greatest("high", "before").alias("high_open"), (F.col("open_weight") == F.col("peak")).alias("is_peak"))
