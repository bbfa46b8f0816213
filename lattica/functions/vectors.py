"""Vectors as arrays of numbers, in double precision."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, floor: float = 1e-12) -> Column:
    """Divided by the Euclidean norm, which counts as ``floor`` at least."""
    size = F.greatest(norm(a), F.lit(floor))
    return F.element_at(F.transform(F.array(size), lambda n: F.transform(a, lambda x: x.cast("double") / n)), 1)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def hash_embedder(width: int = 64, seed: int = 0):
    """A deterministic stand-in for a text encoder: unit vectors of hashed words, as a pandas UDF."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[float]:
            v = np.zeros(width)
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8, key=seed.to_bytes(4, "little")).digest(), "little")
                v[h % width] += 1 if h >> 63 else -1
            size = np.linalg.norm(v)
            return (v / size if size else v).astype(np.float32).tolist()

        return texts.map(one)

    return embed
