"""Readers and writers: JSON and JSONL with containers, concatenated objects, Parquet, CSV, logs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.operators.windows import numbered, running_parts

CONTAINERS = ("data", "examples", "samples")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, skip_malformed: bool = False) -> DataFrame:
    """Rows of JSON Lines (blank lines skipped), of a JSON array, or of a container object; the file's first character and line tell which.

    Malformed text is an error, or left out with ``skip_malformed``. Lines are
    read in splits; an array or container is one text, read by one task a file.
    """
    head = [r["value"] for r in spark.read.text(path).where(F.trim("value") != "").limit(1).collect()]
    whole = bool(head) and not _is_object(head[0])
    reader = spark.read.option("mode", "DROPMALFORMED" if skip_malformed else "FAILFAST").option("multiLine", str(whole).lower())
    return unwrap((reader.schema(schema) if schema else reader).json(path))


def _is_object(line: str) -> bool:
    """Whether a line is a JSON object of its own that is no container."""
    try:
        value = json.loads(line)
    except ValueError:
        # the beginning of an object that goes on, or a bad line
        return line.strip().startswith("{") and len(line.strip()) > 1
    return isinstance(value, dict) and not any(isinstance(value.get(c), list) for c in CONTAINERS)


def load_rows(spark: SparkSession, path: str, schema: str, start: int = 0, limit: int | None = None) -> DataFrame:
    """Rows of a JSON Lines file with their ``source_index`` from 0 in the file, from ``start`` on, ``limit`` at most."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.monotonically_increasing_id().alias("_at"))
    placed = numbered(lines, ["_at"], "source_index", 0)
    upto = F.lit(True) if limit is None else F.col("source_index") < start + limit
    wanted = placed.where((F.col("source_index") >= start) & upto)
    return wanted.select("source_index", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("source_index", "r.*")


def unwrap(df: DataFrame) -> DataFrame:
    """Rows of the first of data, examples and samples that the table has as an array of structs; else the table."""
    for name in CONTAINERS:
        field = next((f for f in df.schema.fields if f.name == name and isinstance(f.dataType, T.ArrayType)), None)
        if field:
            return df.select(F.explode(name).alias("_row")).select("_row.*")
    return df


def read_concatenated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Pretty-printed objects one after another in a file; ``schema`` is that of one object."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = json.JSONDecoder()
        for frame in frames:
            rows = []
            for text in frame["value"]:
                at = 0
                while at < len(text):
                    while at < len(text) and text[at] in " \t\r\n,":
                        at += 1
                    if at < len(text):
                        row, at = decoder.raw_decode(text, at)
                        rows.extend(json.dumps(r) for r in (row if isinstance(row, list) else [row]))
            yield pd.DataFrame({"json": rows})

    raw = spark.read.text(path, wholetext=True).mapInPandas(cut, "json string")
    return raw.select(F.from_json("json", schema).alias("r")).select("r.*")


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def parquet_preview(spark: SparkSession, path: str, columns: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of the named columns; a missing column is an error that names it."""
    df = spark.read.parquet(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns).limit(n)


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resume: the rows whose key isn't in ``done``."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def log_values(lines: DataFrame, marker: str, pattern: str, order: str = "line_no") -> DataFrame:
    """part (running count of marker lines), line and metric of each line that holds the pattern's group; the count runs over range partitions."""
    marked = lines.withColumn("_mark", F.contains("value", F.lit(marker)))
    found = running_parts(marked, order, "_mark").withColumn("found", F.regexp_extract("value", pattern, 1))
    return found.where("found != ''").select("part", order, F.col("found").cast("double").alias("metric"))


def sample_id(*names: str) -> Column:
    """The first of the named columns that isn't null, as text."""
    return F.coalesce(*[F.col(n).cast("string") for n in names])
