"""Small files and foreign stores: SQLite tables, NumPy arrays, manifests, alias files, sizes and digests of a store's files.

Tasks read by path, so paths must lie in a folder that driver and executors share.
"""

from __future__ import annotations

import json
import os
import sqlite3
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, slices: int = 8) -> DataFrame:
    """A SQLite table by ranges of its rowid, a task each; ``schema`` names the columns to read. An empty table gives no rows."""
    names = spark.createDataFrame([], schema).columns
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as base:
        low, high = base.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
    if low is None:
        return spark.createDataFrame([], schema)
    step = -(-(high - low + 1) // slices)
    ranges = spark.createDataFrame([(a, a + step) for a in range(low, high + 1, step)], "a long, b long").repartition(slices)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ", ".join(f'"{n}"' for n in names)
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as base:
            for frame in frames:
                for a, b in zip(frame["a"], frame["b"], strict=True):
                    cursor = base.execute(f'SELECT {columns} FROM "{table}" WHERE rowid >= ? AND rowid < ?', (int(a), int(b)))
                    while rows := cursor.fetchmany(10_000):
                        yield pd.DataFrame(rows, columns=names)

    return ranges.mapInPandas(run, schema)


def write_sqlite(df: DataFrame, path: str, table: str) -> None:
    """Write a table whole or not at all; rows stream through the driver, a partition at a time. Nested columns become JSON."""
    flat = df.select(*[F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, kind in df.dtypes])
    with sqlite3.connect(path) as base:
        base.execute(f'DROP TABLE IF EXISTS "{table}"')
        base.execute(f'CREATE TABLE "{table}" ({", ".join(f"{chr(34)}{c}{chr(34)}" for c in flat.columns)})')
        base.executemany(f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(flat.columns))})', (tuple(r) for r in flat.toLocalIterator()))


def write_atomic(path: str, data: bytes) -> None:
    """Write a small file so that readers see the old one or the new one, never a part."""
    handle, name = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def write_json_atomic(path: str, value: object) -> None:
    write_atomic(path, (json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode())


def read_npy(spark: SparkSession, path: str, rows_per_task: int = 100_000) -> DataFrame:
    """row and vector (array of floats) of a two-dimensional .npy array, mapped, read by ranges of rows."""
    n = np.load(path, mmap_mode="r").shape[0]
    ranges = spark.createDataFrame([(a, min(n, a + rows_per_task)) for a in range(0, n, rows_per_task)], "a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = np.load(path, mmap_mode="r")
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                for at in range(a, b, 4096):
                    part = np.asarray(array[at : min(b, at + 4096)], np.float32)
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * part.shape[1], pa.int32()), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), vectors], names=["row", "vector"])

    return ranges.mapInArrow(run, "row long, vector array<float>")


def write_npy(df: DataFrame, path: str, order: str = "row", column: str = "vector", append: bool = False) -> tuple[int, int]:
    """Write vectors in order as one .npy array, whole or not at all; with ``append`` behind those the file has.

    Gives the first new row and the row after the last one. Vectors of another
    length than the first one's, or than the file's, are an error. Rows stream through the driver.
    """
    old = np.load(path, mmap_mode="r") if append and os.path.exists(path) else None
    first = 0 if old is None else len(old)
    n = df.count()
    width = old.shape[1] if old is not None else (len(df.select(column).first()[0]) if n else 0)
    name = f"{path}.new"
    out = np.lib.format.open_memmap(name, mode="w+", dtype=np.float32, shape=(first + n, width))
    try:
        if old is not None:
            out[:first] = old
        for k, row in enumerate(df.orderBy(order).select(column).toLocalIterator(), first):
            if len(row[0]) != width:
                raise ValueError(f"a vector of {len(row[0])} numbers in an array of {width}")
            out[k] = row[0]
        out.flush()
    except BaseException:
        os.unlink(name)
        raise
    os.replace(name, path)
    return first, first + n


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """alias and name of a JSON object that sends aliases to names."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("alias", "name"))


def file_report(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and sha256 of every file below a folder, read by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
