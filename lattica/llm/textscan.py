"""Vectorised scanning of Arrow string columns: words, word hashes and n-gram hashes.

Texts are read as the UTF-8 bytes that Arrow already holds, a few MB at a time,
so memory is bounded by the slice size and by the longest single text. Every
function treats a null text as an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

U64 = np.uint64
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240607)
_BYTE_CODES = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_STEP = U64(0x9E3779B97F4A7C15)
_BACK = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """``mapInArrow``, after which a worker hands back the memory it no longer uses: workers live on over stages, idle ones too."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return df.mapInArrow(lean, ddl)


def byte_mask(spec: bytes) -> np.ndarray:
    """True for the listed byte values."""
    mask = np.zeros(256, bool)
    mask[np.frombuffer(spec, np.uint8)] = True
    return mask


#: Bytes that separate words, [\x20\x09-\x0D].
SPACES = byte_mask(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Bytes outside words once lower-cased, [\x00-\x2F\x3A-\x60\x7B-\x7F].
NOT_ALNUM = byte_mask(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        step = _STEP if which == "up" else _BACK
        full = np.full(max(n, 2 * len(have), 1 << 16), step, np.uint64)
        full[0] = 1
        have = _powers[which] = np.cumprod(full)
    return have[:n]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start, n = 0, len(sizes)
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and the n+1 offsets of the texts."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def fixed_bytes(column: pa.Array, width: int) -> np.ndarray:
    """A binary column whose values all have ``width`` bytes, a row for each; no copy is made."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, width)


class Words:
    """The words of a slice: byte bounds, the text each one is in, and prefix sums that hash any byte range."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, apart: np.ndarray, lower: bool = True):
        self.n_docs = len(offsets) - 1
        self.data = LOWER[data] if lower else data
        inside = ~apart[self.data]
        n = len(inside)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begins = offsets[:-1][np.diff(offsets) > 0]
        first[begins] = inside[begins]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[begins[1:] - 1] = inside[begins[1:] - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.bounds = np.searchsorted(self.doc, np.arange(self.n_docs + 1))
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_CODES[self.data] * _power("up", n), out=self._sums[1:])

    def range_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges; equal bytes give equal hashes wherever they stand."""
        back = _power("down", len(self._sums))
        return mix((self._sums[ends] - self._sums[starts]) * back[starts])

    def hashes(self) -> np.ndarray:
        return self.range_hash(self.starts, self.ends)

    def grams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of each run of ``k`` words of one text."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = hashes[:n].copy()
        for j in range(1, k):
            total = total * _STEP + hashes[j : j + n]
        keep = self.doc[:n] == self.doc[k - 1 :]
        return np.flatnonzero(keep), mix(total[keep])


def as_batches(frames: Iterator[dict[str, object]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for columns in frames:
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)
