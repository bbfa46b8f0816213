"""A stream of sample files into a growing table of triples: bounded chunks, restarts, bad lines apart, rounds as versions.

Every chunk is a micro-batch of at most ``files`` files. The stream's checkpoint
says which files are done, so a restart goes on after the last whole chunk. What a
chunk writes lies in a folder of its own named by the chunk's number and replaces
what an attempt before it may have left, so a chunk that is tried again leaves no
row twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lattica.operators import store
from lattica.sources import samples


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, dataset_id: str, files: int = 100) -> StreamingQuery:
    """Read the JSON Lines files that ``source`` has and will have; triples, samples and bad lines go to folders below ``target``.

    A line that isn't JSON goes to ``rejected`` with its file and reason and stops
    nothing. Blank lines are skipped. The query ends when all files there are done.
    """
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files).load(source)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")

    def write(batch: DataFrame, number: int) -> None:
        # a sample without an id is known by its file and text, which a second attempt gives again
        read = batch.withColumns({"json": F.col("value"), "source_index": F.xxhash64("file", "value"), "good": F.try_parse_json("value").isNotNull()})
        read.where("not good").select("file", "value", F.lit("not JSON").alias("reason")).write.mode("overwrite").parquet(f"{target}/rejected/round={number}")
        parsed = samples.parse(read.where("good"))
        samples.questions(parsed).write.mode("overwrite").parquet(f"{target}/samples/round={number}")
        store.parsed(samples.triples(parsed, dataset_id)).write.mode("overwrite").parquet(f"{target}/triples/round={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upto(spark: SparkSession, target: str, name: str, number: int | None = None) -> DataFrame:
    """A table of the target as it was after a round; all rounds without a number."""
    df = spark.read.parquet(f"{target}/{name}")
    return df if number is None else df.where(F.col("round") <= number)


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of a stream or table of events (ts, event_type, value) by tumbling window; events later than ``late`` are left out of a stream."""
    timed = events.withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")
