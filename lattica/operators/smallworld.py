"""Vector search over navigable small-world graphs: layers of neighbours, one graph for each shard, kept on disk.

Vectors are dealt into shards of a bounded size by a hash of their id. A task lays
out a shard's graph: every vector is in layer 0, one of ``LINKS`` of a layer is in
the next one too, and in each layer a vector is linked to near ones that lie apart
from each other. A shard is one row, so a search reads the index as it lies, without
an exchange: each task walks its shards from the top layer down with a beam and
keeps its best for each query, and only those meet.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.operators.search import BLOCK_ROWS

#: Links of a vector in a layer (twice as many in layer 0), width of the beam that picks them, and vectors of a shard.
LINKS, WIDTH, SHARD_ROWS = 16, 64, 8_000
INDEX = "shard int, size int, ids binary, vectors binary, levels binary, links binary, starts binary"


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.maximum(size, 1e-12)).astype(np.float32)


def _near(x: np.ndarray, rows: np.ndarray, among: np.ndarray, n: int) -> np.ndarray:
    """For each of ``rows`` its ``n`` nearest of ``among`` besides itself, nearest first; -1 where there are fewer."""
    out = np.full((len(rows), n), -1, np.int32)
    take = min(n + 1, len(among))
    for a in range(0, len(rows), 1024):
        s = x[rows[a : a + 1024]] @ x[among].T
        best = np.argpartition(-s, take - 1, 1)[:, :take]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(s, best, 1), 1, kind="stable"), 1)
        for k, (row, own) in enumerate(zip(rows[a : a + 1024], among[best], strict=True), a):
            own = own[own != row][:n]
            out[k, : len(own)] = own
    return out


def _apart(x: np.ndarray, node: int, near: np.ndarray, most: int) -> list[int]:
    """Of near vectors those that are nearer to the node than to one taken before, filled up with the nearest."""
    near = near[near >= 0]
    to_node, each = x[near] @ x[node], x[near] @ x[near].T
    taken: list[int] = []
    for k in range(len(near)):
        if len(taken) == most:
            break
        if not taken or each[k, taken].max() < to_node[k]:
            taken.append(k)
    rest = [k for k in range(len(near)) if k not in set(taken)]
    return near[taken + rest[: most - len(taken)]].tolist()


def layers(ids: np.ndarray, links: int = LINKS) -> np.ndarray:
    """The top layer of each vector, by a hash of its id: one of ``links`` of a layer is in the next."""
    h = pd.util.hash_array(ids.astype(np.int64)).astype(np.float64)
    return np.minimum(np.floor(-np.log((h + 1) / 2.0**64) / math.log(links)), 12).astype(np.int8)


def graph(ids: np.ndarray, x: np.ndarray, links: int = LINKS, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """levels, links and starts of unit vectors: links[starts[l * n + i]:starts[l * n + i + 1]] are those of vector i in layer l."""
    n, levels = len(x), layers(ids, links)
    if n:
        levels[np.argmax(levels)] = levels.max()
    flat, starts = [], [0]
    for layer in range(int(levels.max()) + 1 if n else 0):
        members = np.flatnonzero(levels >= layer)
        most = links * (2 if layer == 0 else 1)
        near = _near(x, members, members, min(width, len(members)))
        own: list[set[int]] = [set() for _ in range(n)]
        for row, found in zip(members.tolist(), near, strict=True):
            for other in _apart(x, row, found, most // 2):
                own[row].add(other)
                own[other].add(row)
        # ways up and out: the nearest vectors of the layers above
        for above in range(layer + 1, int(levels.max()) + 1):
            upper = np.flatnonzero(levels >= above)
            for row, found in zip(members.tolist(), _near(x, members, upper, 2), strict=True):
                for other in found[found >= 0].tolist():
                    own[row].add(other)
                    own[other].add(row)
        for row in range(n):
            held = np.fromiter(own[row], np.int32, len(own[row]))
            if len(held) > 2 * most:  # a hub keeps those that lie apart
                order = held[np.argsort(-(x[held] @ x[row]), kind="stable")]
                held = np.array(_apart(x, row, order, 2 * most), np.int32)
            flat.append(np.sort(held))
            starts.append(starts[-1] + len(held))
    return levels, np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32), np.array(starts, np.int64)


class Walk:
    """A shard that can be searched."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, levels: np.ndarray, links: np.ndarray, starts: np.ndarray):
        self.ids, self.x, self.levels, self.links, self.starts = ids, x, levels, links, starts
        self.top = int(levels.max()) if len(levels) else 0
        self.entry = int(np.argmax(levels)) if len(levels) else -1

    def _beam(self, q: np.ndarray, layer: int, entries: list[tuple[float, int]], width: int) -> list[tuple[float, int]]:
        n = len(self.x)
        seen = np.zeros(n, bool)
        seen[[i for _, i in entries]] = True
        open_, best = [(-s, i) for s, i in entries], list(entries)
        heapq.heapify(open_)
        heapq.heapify(best)
        while open_:
            s, i = heapq.heappop(open_)
            if len(best) >= width and -s < best[0][0]:
                break
            at = layer * n + i
            near = self.links[self.starts[at] : self.starts[at + 1]]
            near = near[~seen[near]]
            seen[near] = True
            for score, j in zip((self.x[near] @ q).tolist(), near.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (score, j))
                elif score > best[0][0]:
                    heapq.heapreplace(best, (score, j))
                else:
                    continue
                heapq.heappush(open_, (-score, j))
        return best

    def search(self, q: np.ndarray, k: int, width: int) -> list[tuple[float, int]]:
        """(score, id) of the best that a beam of ``width`` finds."""
        if self.entry < 0:
            return []
        found = [(float(self.x[self.entry] @ q), self.entry)]
        for layer in range(self.top, 0, -1):
            found = self._beam(q, layer, found, LINKS)
        found = self._beam(q, 0, found, max(width, k))
        return [(s, int(self.ids[i])) for s, i in sorted(found, key=lambda f: (-f[0], self.ids[f[1]]))[:k]]


def build(vectors: DataFrame, shard_rows: int = SHARD_ROWS, links: int = LINKS, width: int = WIDTH) -> DataFrame:
    """The index of vectors (node_id, embedding): a row for each shard.

    Every vector but null ones, which are like nothing, is in one shard; a repeated
    id keeps each of its vectors. A shard has about ``shard_rows`` vectors, so what a
    task holds doesn't grow with the table. No vectors give no rows.
    """
    given = vectors.where("embedding IS NOT NULL AND node_id IS NOT NULL").select("node_id", F.col("embedding").cast("array<float>").alias("embedding"))
    n = given.count()
    shards = max(1, -(-n // shard_rows))

    def lay(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node_id", kind="stable")
        ids, x = rows["node_id"].to_numpy(np.int64), _unit(np.stack(rows["embedding"].to_numpy()).astype(np.float32))
        levels, flat, starts = graph(ids, x, links, width)
        return pd.DataFrame([(key[0], len(ids), *(a.tobytes() for a in (ids, x, levels, flat, starts)))], columns=["shard", "size", "ids", "vectors", "levels", "links", "starts"])

    return given.groupBy(F.pmod(F.xxhash64("node_id"), F.lit(shards)).cast("int").alias("shard")).applyInPandas(lay, INDEX)


class SmallWorld:
    """An index at a path; ``build_at`` writes it once, and whoever opens the path reads what lies there."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.rows = path, spark.read.schema(INDEX).parquet(path)

    @classmethod
    def build_at(cls, vectors: DataFrame, path: str, **how: int) -> SmallWorld:
        build(vectors, **how).write.mode("overwrite").parquet(path)
        return cls(vectors.sparkSession, path)

    def search(self, queries: DataFrame, k: int, width: int = WIDTH) -> DataFrame:
        """qid, node_id, score, rank: the best that beams of ``width`` find for each query (qid, vector); ties by node_id.

        Queries go out in blocks of a bounded size; a null vector finds nothing.
        """
        spark = self.rows.sparkSession
        schema = pa.schema([("qid", pa.int64()), ("node_id", pa.int64()), ("score", pa.float64())])
        asked = queries.where("vector IS NOT NULL").select(F.col("qid").cast("long").alias("qid"), F.col("vector").cast("array<float>").alias("vector"))
        blocks = -(-asked.count() // BLOCK_ROWS)
        out = None
        for b in range(blocks if k > 0 else 0):
            block = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).collect()
            shared = spark.sparkContext.broadcast(([r.qid for r in block], _unit(np.array([r.vector for r in block], np.float32))))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                names, q = shared.value
                best: list[list[tuple[float, int]]] = [[] for _ in names]
                for batch in batches:
                    for row in batch.to_pylist():
                        x = np.frombuffer(row["vectors"], np.float32).reshape(row["size"], -1)
                        walk = Walk(np.frombuffer(row["ids"], np.int64), x, *(np.frombuffer(row[c], t) for c, t in (("levels", np.int8), ("links", np.int32), ("starts", np.int64))))
                        for i, v in enumerate(q):
                            best[i] = sorted(best[i] + walk.search(v, k, width), key=lambda f: (-f[0], f[1]))[:k]
                flat = [(name, node, score) for name, found in zip(names, best, strict=True) for score, node in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat, strict=True) if flat else ((), (), ()), schema.types, strict=True)], schema=schema)

            met = self.rows.mapInArrow(run, "qid long, node_id long, score double")
            out = met if out is None else out.union(met)
        if out is None:
            return spark.createDataFrame([], "qid long, node_id long, score double, rank int")
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "node_id"))
        return out.withColumn("rank", rank).where(F.col("rank") <= k)
