"""Approximate vector search: inverted lists around centroids that a bounded sample gives; every vector is in one list.

A query looks into the lists of its nearest centroids and ranks what they hold by
exact cosine, so the result is part of an exact search's scores. Looking into all
lists is the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.search import nearest, top_k

#: Bound of the vectors that the centroids are fitted on, picked by hash of the id, and of the centroids.
SAMPLE, MOST_LISTS = 20_000, 1024


def centroids(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Unit centroids of a sample of vectors (node_id, embedding): about the root of the sample's size of them, MOST_LISTS at most. Zero and null vectors teach nothing."""
    picked = vectors.where("embedding is not null").orderBy(F.xxhash64("node_id"), "node_id").limit(sample).select("embedding")
    x = np.array([r[0] for r in picked.collect()], float)
    size = np.linalg.norm(x, axis=1) if len(x) else np.zeros(0)
    x = x[size > 0] / size[size > 0, None] if len(x) else np.zeros((0, 1))
    if not len(x):
        return x
    k = min(len(x), MOST_LISTS, lists or max(1, int(len(x) ** 0.5)))
    at = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = (x @ at.T).argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1)
        at = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-12)[:, None], at)
    return at


def _nearest(df: DataFrame, column: str, at: np.ndarray, n: int, name: str) -> DataFrame:
    """Add the ``n`` nearest centroids of a vector column as an array; a null vector is near the first."""
    shared = df.sparkSession.sparkContext.broadcast(at)
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for batch in batches:
            given = batch.column(column).to_pylist()
            x = np.array([v if v is not None else np.zeros(at.shape[1]) for v in given], float).reshape(len(given), -1)
            near = np.argsort(-(x @ at.T), 1, kind="stable")[:, :n]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, name])

    return df.mapInArrow(run, f"{kinds}, {name} array<int>")


class Index:
    """Vectors (node_id, embedding) with the list each one is in; ``write`` keeps it as a table partitioned by list."""

    def __init__(self, vectors: DataFrame, lists: int | None = None):
        self.at = centroids(vectors, lists)
        given = vectors.select("node_id", "embedding")
        placed = _nearest(given, "embedding", self.at, 1, "_l") if len(self.at) else given.withColumn("_l", F.array(F.lit(0)))
        self.rows = placed.select("node_id", "embedding", F.get("_l", 0).alias("list"))

    def write(self, path: str) -> None:
        self.rows.write.mode("overwrite").partitionBy("list").parquet(path)

    def search(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """qid, node_id, score, rank: the best of the lists of each query's (qid, vector) ``probes`` nearest centroids; ties by node_id."""
        if k <= 0 or not len(self.at):
            return top_k(queries, self.rows.where("false").select("node_id", "embedding"), 0)
        asked = _nearest(queries.select("qid", "vector"), "vector", self.at, min(probes, len(self.at)), "_l")
        return nearest(asked if probes < len(self.at) else asked.drop("_l"), self.rows, k)


def search(queries: DataFrame, vectors: DataFrame, k: int, backend: str = "auto", probes: int = 8, index: Index | None = None) -> DataFrame:
    """Search by a backend: exact, lists, or auto, which takes the ``index`` if there is one, else is exact. A ``k`` of 0 or less gives no rows.

    ``lists`` without an index builds one. The size of the table never changes what a call returns.
    """
    if backend not in ("auto", "exact", "lists"):
        raise ValueError(f"no backend {backend}")
    if backend == "exact" or backend == "auto" and index is None:
        return top_k(queries, vectors, k)
    return (index or Index(vectors)).search(queries, k, probes)


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """qid, k, same and recall: how many of a query's exact hits (qid, node_id) were found."""
    same = exact.select("qid", "node_id").join(found.select("qid", "node_id", F.lit(1).alias("hit")), ["qid", "node_id"], "left")
    return same.groupBy("qid").agg(F.count("*").alias("k"), F.count("hit").alias("same")).withColumn("recall", F.col("same") / F.col("k"))
