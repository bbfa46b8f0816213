"""SentencePiece BPE encoding with seeded merge-dropout, and its lossless decoding.

A text is cut into pre-tokens, each a run of word marks and what follows up to
the next mark; no piece of the vocabulary reaches across such a cut. In each
pre-token neighbouring symbols are merged by the vocabulary's scores, best first
and leftmost first among equals. A merge candidate (place, left, right) is
skipped for good when a hash keyed by the seed and by the occurrence (document
and place of the pre-token in it) falls below the dropout rate, so segmentations
vary from occurrence to occurrence, repeat from run to run, and always decode to
the same text.

The merges of a pre-token without dropout are found once in a slice. An
occurrence none of whose merges is skipped has that segmentation; every other one
runs its own agenda: short ones side by side as rows of a matrix, long ones over
a heap. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lattica.llm.columns import needed
from lattica.llm.textscan import U64, as_batches, map_arrow, mix, slices

MARK = 0x2581
#: Symbols at or above this are characters without a piece: UNKNOWN + code point.
UNKNOWN = 1 << 15
NEVER = np.int64(2**62)
#: Pre-tokens of more characters than this go through the heap agenda.
MATRIX_CHARS = 48
SLICE = 1 << 20


class PieceModel:
    """The merge table of a SentencePiece BPE model with byte fallback."""

    def __init__(self, model: bytes):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = lib.get_piece_size()
        if n >= UNKNOWN:
            raise ValueError(f"a vocabulary of {n} pieces; symbols have 15 bits")
        normal = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        text = {i: lib.id_to_piece(i) for i in normal}
        self.ids = {t: i for i, t in text.items()}
        if across := [t for t in self.ids if chr(MARK) in t.lstrip(chr(MARK))]:
            raise ValueError(f"pieces that reach across a word mark: {across[:3]}")
        self.byte_ids = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        scores = {i: lib.get_score(i) for i in normal}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.of_char = np.full(0x110000, -1, np.int32)
        for t, i in self.ids.items():
            if len(t) == 1:
                self.of_char[ord(t)] = i
        keys, ranks, made = [], [], []
        for i, t in text.items():
            for cut in range(1, len(t)):
                left, right = self.ids.get(t[:cut]), self.ids.get(t[cut:])
                if left is not None and right is not None:
                    keys.append(left << 15 | right)
                    ranks.append(order[scores[i]])
                    made.append(i)
        self._index(np.array(keys, np.int64), np.array(ranks, np.int32), np.array(made, np.int32))
        self.merges = dict(zip(keys, zip(ranks, made, strict=True), strict=True))
        pieces = [text[i].replace(chr(MARK), " ").encode() if i in text else b"" for i in range(n)]
        for b, i in enumerate(self.byte_ids):
            pieces[i] = bytes([b])
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])

    def _index(self, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray) -> None:
        """An open-addressed table; probes that end at an empty cell say that no merge exists."""
        bits = int(np.ceil(np.log2(max(16, len(keys) * 4))))
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.cells, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NEVER)
        left, place = np.arange(len(keys)), self._cell(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.cells[place] < 0
            _, first = np.unique(np.where(free, place, -1 - np.arange(len(place))), return_index=True)
            first = first[free[first]]
            at, k = place[first], left[first]
            self.cells[at], self.values[at] = keys[k], ranks[k].astype(np.int64) << 16 | made[k]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, place = left[rest], (place[rest] + 1) & self.mask

    def _cell(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def merge_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 16 | result of merging each pair; NEVER where the pair can't merge."""
        keys = left << 15 | right
        odd = (left < 0) | (right < 0) | (left >= UNKNOWN) | (right >= UNKNOWN)
        keys[odd] = -2
        place = self._cell(keys)
        cell = self.cells[place]
        value = self.values[place]
        missed = np.flatnonzero(cell != keys)
        value[missed] = NEVER
        open_ = missed[(cell[missed] >= 0) & (keys[missed] >= 0)]
        at, key = place[open_], keys[open_]
        for _ in range(self.probes):
            if not len(at):
                break
            at = (at + 1) & self.mask
            cell = self.cells[at]
            found = cell == key
            value[open_[found]] = self.values[at[found]]
            go = ~found & (cell >= 0)
            at, key, open_ = at[go], key[go], open_[go]
        return value

    def symbols(self, points: np.ndarray) -> np.ndarray:
        ids = self.of_char[points]
        return np.where(ids >= 0, ids, UNKNOWN + points.astype(np.int32))


@lru_cache(maxsize=2)
def load(model: bytes) -> PieceModel:
    return PieceModel(model)


def _candidate(place: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return place.astype(np.uint64) * U64(0xC2B2AE3D27D4EB4F) + left.astype(np.uint64) * U64(0x165667B19E3779F9) + right.astype(np.uint64) * U64(0xD6E8FEB86659FD93)


def _skipped(keys: np.ndarray, candidate: np.ndarray, bar: int) -> np.ndarray:
    return (mix(keys + candidate) >> U64(11)) < U64(bar)


def segment_matrix(model: PieceModel, symbols: np.ndarray, keys: np.ndarray, bar: int, made: list[tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
    """Segment the rows of a matrix of symbols, padded with -1; the rows come back shortened in the same way.

    The merges made are appended to ``made`` as (rows, candidates).

    Each round merges the best candidate of every row that has one. A cell holds
    place << 32 | symbol; a candidate holds rank << 16 | merged symbol.
    """
    n, width = symbols.shape
    out = np.full((n, width), -1, np.int32)
    if width < 2:
        return symbols.astype(np.int32)
    low = (1 << 32) - 1

    def candidates(left: np.ndarray, right: np.ndarray, of: np.ndarray) -> np.ndarray:
        place, left, right = left >> 32, left & low, right & low
        value = model.merge_of(left, right)
        if bar:
            can = np.flatnonzero(value != NEVER)
            value[can[_skipped(of[can], _candidate(place[can], left[can], right[can]), bar)]] = NEVER
        return value

    pad = symbols < 0
    cells = np.arange(width, dtype=np.int64) << 32 | np.where(pad, low, symbols)
    ranked = candidates(cells[:, :-1].ravel(), cells[:, 1:].ravel(), np.repeat(keys, width - 1)).reshape(n, width - 1)
    rows = np.arange(n)

    def finish(which: np.ndarray) -> None:
        left = (cells[which] & low).astype(np.int64)
        out[rows[which], : left.shape[1]] = np.where(left == low, -1, left)

    while True:
        best = ranked.argmin(1)
        top = ranked[np.arange(len(rows)), best]
        done = top == NEVER
        if done.any():
            finish(done)
            go = ~done
            rows, cells, ranked, keys, best, top = rows[go], cells[go], ranked[go], keys[go], best[go], top[go]
        if not len(rows):
            return out
        lane, width = np.arange(len(rows)), cells.shape[1]
        if made is not None:
            made.append((rows, _candidate(cells[lane, best] >> 32, cells[lane, best] & low, cells[lane, best + 1] & low)))
        cells[lane, best] = cells[lane, best] >> 32 << 32 | top & 0xFFFF
        keep = np.ones(cells.shape, bool)
        keep[lane, best + 1] = False
        cells = cells[keep].reshape(len(rows), width - 1)
        if width == 2:
            finish(lane)
            return out
        keep = np.ones(ranked.shape, bool)
        keep[lane, best] = False
        ranked = ranked[keep].reshape(len(rows), width - 2)
        a, b = np.flatnonzero(best > 0), np.flatnonzero(best < width - 2)
        row, col = np.concatenate([a, b]), np.concatenate([best[a] - 1, best[b]])
        ranked[row, col] = candidates(cells[row, col], cells[row, col + 1], keys[row])


def segment_heap(model: PieceModel, symbols: list[int], key: int, bar: int, made: list[int] | None = None) -> list[int]:
    """Segment one long pre-token with a heap agenda over linked symbols; the merges made are appended to ``made``."""
    n = len(symbols)
    after, before, alive, agenda = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n, []
    symbols = list(symbols)
    key_array = np.array([key], np.uint64)

    def offer(i: int) -> None:
        j = after[i]
        if j < 0 or symbols[i] >= UNKNOWN or symbols[j] >= UNKNOWN:
            return
        merge = model.merges.get(symbols[i] << 15 | symbols[j])
        if merge and not (bar and _skipped(key_array, _candidate(*np.array([[i], [symbols[i]], [symbols[j]]])), bar)[0]):
            heapq.heappush(agenda, (merge[0], i, j, symbols[i], symbols[j], merge[1]))

    for i in range(n):
        offer(i)
    while agenda:
        _, i, j, left, right, new = heapq.heappop(agenda)
        if not (alive[i] and alive[j] and symbols[i] == left and symbols[j] == right and after[i] == j):
            continue
        if made is not None:
            made.append(int(_candidate(*np.array([[i], [left], [right]]))[0]))
        symbols[i], alive[j], after[i] = new, False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [s for s, a in zip(symbols, alive, strict=True) if a]


def ragged_take(values: np.ndarray, offsets: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked rows of a ragged array, one after another, and their offsets."""
    lens = offsets[picks + 1] - offsets[picks]
    ends = np.concatenate([[0], np.cumsum(lens)])
    return values[np.repeat(offsets[picks] - ends[:-1], lens) + np.arange(ends[-1])], ends


def _fall_back(model: PieceModel, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace characters without a piece by the pieces of their bytes."""
    odd = np.flatnonzero(flat >= UNKNOWN)
    if not len(odd):
        return flat, offsets
    raw = [chr(c).encode("utf-8", "surrogatepass") for c in (flat[odd] - UNKNOWN).tolist()]
    counts = np.ones(len(flat), np.int64)
    counts[odd] = [len(b) for b in raw]
    ends = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(ends[-1], np.int32)
    plain = flat < UNKNOWN
    out[ends[:-1][plain]] = flat[plain]
    out[np.repeat(ends[:-1][odd] - np.concatenate([[0], np.cumsum(counts[odd])[:-1]]), counts[odd]) + np.arange(counts[odd].sum())] = model.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    return out, ends[offsets]


def _segment_all(model: PieceModel, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, keys: np.ndarray, bar: int, trace: bool = False):
    """Ids of the pre-tokens symbols[begin : begin + size] one after another, their offsets, and with ``trace`` (rows, candidates) of the merges made."""
    parts, counts = [(np.zeros(0, np.int64), np.zeros(0, np.int32))], np.zeros(len(begin), np.int64)
    rows_made, made = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    order = np.argsort(size, kind="stable")
    short = order[: int(np.searchsorted(size[order], MATRIX_CHARS, "right"))]
    k = 0
    while k < len(short):
        width = int(size[short[k]])
        stop = int(np.searchsorted(size[short], width + max(0, width // 6), "right"))
        stop = min(stop, k + max(1, 100_000 // width))
        rows = short[k:stop]
        width = int(size[rows[-1]])
        grid = begin[rows][:, None] + np.arange(width)
        inside = np.arange(width) < size[rows][:, None]
        cells = np.where(inside, symbols[np.minimum(grid, len(symbols) - 1)], -1)
        steps: list[tuple[np.ndarray, np.ndarray]] | None = [] if trace else None
        done = segment_matrix(model, cells, keys[rows], bar, steps)
        have = done >= 0
        counts[rows] = have.sum(1)
        parts.append((rows, done[have]))
        for lane, candidate in steps or ():
            rows_made.append(rows[lane])
            made.append(candidate)
        k = stop
    for row in order[len(short) :]:
        own: list[int] | None = [] if trace else None
        ids = segment_heap(model, symbols[begin[row] : begin[row] + size[row]].tolist(), int(keys[row]), bar, own)
        counts[row] = len(ids)
        parts.append((np.array([row]), np.array(ids, np.int32)))
        if own:
            rows_made.append(np.full(len(own), row))
            made.append(np.array(own, np.uint64))
    laid = np.concatenate([r for r, _ in parts])
    flat = np.concatenate([v for _, v in parts]).astype(np.int32)
    flat, offsets = _fall_back(model, flat, np.concatenate([[0], np.cumsum(counts[laid])]))
    where = np.empty(len(laid), np.int64)
    where[laid] = np.arange(len(laid))
    ids, ends = ragged_take(flat, offsets, where)
    return ids, ends, (np.concatenate(rows_made), np.concatenate(made))


def encode_texts(model: PieceModel, texts: list[str], doc_keys: np.ndarray, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, one after another, and the texts' offsets.

    An empty text has no ids. A literal word mark in a text goes through its
    bytes, as it would otherwise decode to a space.
    """
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.array([len(t) for t in texts], np.int64)
    full = lens > 0
    # a mark before every text that isn't empty
    ends = np.cumsum(lens)
    at = (ends - lens)[full]
    literal = np.insert(points == MARK, at, False)
    marked = np.insert(np.where(points == 32, np.uint32(MARK), points), at, np.uint32(MARK))
    doc_starts = np.concatenate([[0], np.cumsum(lens + full)])
    if not len(marked):
        return np.zeros(0, np.int32), doc_starts
    is_mark = (marked == MARK) & ~literal
    first = is_mark.copy()
    first[1:] &= ~is_mark[:-1]
    first[doc_starts[:-1][full]] = True
    starts = np.flatnonzero(first)
    stops = np.append(starts[1:], len(marked))
    doc = np.searchsorted(doc_starts, starts, "right") - 1
    index = np.arange(len(starts)) - np.searchsorted(doc, doc)
    # equal pre-tokens by a hash of their characters
    step, n = U64(0x9E3779B97F4A7C15), len(marked)
    power, back = np.full(n, step, np.uint64), np.full(n, U64(pow(0x9E3779B97F4A7C15, -1, 2**64)), np.uint64)
    power[0] = back[0] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(marked.astype(np.uint64) + (literal.astype(np.uint64) << U64(32)) + U64(0x51ED27)) * np.cumprod(power), out=sums[1:])
    size = stops - starts
    tag = mix((sums[stops] - sums[starts]) * np.cumprod(back)[starts] + size.astype(np.uint64))
    _, pick, inverse = np.unique(tag, return_index=True, return_inverse=True)
    inverse = inverse.reshape(-1)
    symbols = model.symbols(marked)
    symbols[literal] = UNKNOWN + MARK
    bar = int(dropout * 2**53)
    ids, bounds, (rows, made) = _segment_all(model, symbols, starts[pick], size[pick], np.zeros(len(pick), np.uint64), 0, trace=bar > 0)
    where = inverse.copy()
    if bar:
        by = np.argsort(rows, kind="stable")
        made, made_at = made[by], np.searchsorted(rows[by], np.arange(len(pick) + 1))
        key = mix(mix(doc_keys[doc] + U64(seed)) + index.astype(np.uint64))
        merges, merge_ends = ragged_take(made, made_at, inverse)
        skips = np.concatenate([[0], np.cumsum(_skipped(np.repeat(key, np.diff(merge_ends)), merges, bar))])
        own = np.flatnonzero(skips[merge_ends[1:]] > skips[merge_ends[:-1]])
        own_ids, own_bounds, _ = _segment_all(model, symbols, starts[own], size[own], key[own], bar)
        where[own] = len(pick) + np.arange(len(own))
        ids, bounds = np.concatenate([ids, own_ids]), np.concatenate([bounds, bounds[-1] + own_bounds[1:]])
    out, word_ends = ragged_take(ids, bounds, where)
    return out, word_ends[np.searchsorted(doc, np.arange(len(texts) + 1))]


def decode_ids(model: PieceModel, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The UTF-8 texts of runs of ids; the mark that encoding put first is taken off."""
    raw, ends = ragged_take(model.piece_bytes, model.piece_offsets, ids)
    data, bounds = raw.tobytes(), ends[offsets]
    return [data[a + (b > a) : b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def read_model(path: str) -> bytes:
    """The driver reads the vocabulary file; tasks get its bytes (half a MB)."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 17, with_ids: bool = True) -> DataFrame:
    """Encode every text of ``docs`` with merge-dropout and check that it decodes to itself.

    Returns per row: doc_id, n_bytes, n_tokens, ids_sha256 (of the ids as 32-bit
    little-endian integers), lossless, and with ``with_ids`` token_ids. A null or
    empty text has no tokens. Equal texts under different ids vary like any two
    occurrences; repeated rows give equal results.
    """
    model_bytes = read_model(model_path)
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("lossless", pa.bool_())] + [("token_ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_bytes)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts = [t or "" for t in part.column("text").to_pylist()]
                keys = mix(pc.fill_null(part.column("doc_id"), -1).to_numpy(zero_copy_only=False).astype(np.uint64))
                ids, offsets = encode_texts(model, texts, keys, dropout, seed)
                raw = [t.encode() for t in texts]
                decoded = decode_ids(model, ids, offsets)
                out = {
                    "doc_id": part.column("doc_id"),
                    "n_bytes": [len(r) for r in raw],
                    "n_tokens": np.diff(offsets),
                    "ids_sha256": [hashlib.sha256(ids[a:b].astype("<i4").tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)],
                    "lossless": [a == b for a, b in zip(raw, decoded, strict=True)],
                }
                if with_ids:
                    out["token_ids"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield from as_batches([out], schema)

    ddl = "doc_id long, n_bytes long, n_tokens long, ids_sha256 string, lossless boolean" + ", token_ids array<int>" * with_ids
    return map_arrow(needed(docs, doc_id="long", text="string"), run, ddl)
