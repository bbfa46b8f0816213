"""Packing documents into sequences of a fixed length by minimum bin slack.

How full sequences can be made depends only on how many pieces there are of each
length, a table of at most ``capacity`` counts however many documents there are.
From it the plan is made: a sequence starts with the longest piece left, and a
subset-sum over bitsets of reachable sums finds the fullest combination of the
lengths left for the rest of it. The combination is removed as often as the counts
allow, so the plan has a bounded number of patterns. Pieces are then ranked by
length over range partitions and each finds its place from its rank alone.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.columns import needed
from lattica.llm.pieces import read_model
from lattica.llm.textscan import as_batches, map_arrow, slices
from lattica.operators.windows import numbered
from lattica.session import saved

CAPACITY, END_ID = 2048, 0
#: A worker forgets the ids of its chunks when it holds so many, and never keeps those of chunks longer than this.
TABLE_ROWS, LONGEST_KEPT = 600_000, 64
_odd_blank = re.compile(r" (?!\S)")
_cut = re.compile(r" (?=\S)")
#: Chunks of letters alone, marks after them, or a line's end and letters after it: their pre-tokens are plain to see.
_letters = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_words = re.compile(rf"([{_letters}]+)([.,;:!?]+)?(?:\n([{_letters}]+))?\Z")


def chunks(text: str) -> list[str]:
    """The text cut at each blank before a visible character; the blank belongs to the chunk after it and is left out here.

    A byte-level vocabulary's pre-tokens never reach over such a cut, so the ids of
    a text are those of its chunks, one after another.
    """
    return _cut.split(text) if _odd_blank.search(text) else text.split(" ")


def byte_signs() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return {b: chr(b if b in own else next(others)) for b in range(256)}


class Ids(dict):
    """From a chunk, after what stands before it, to its ids as little-endian 32-bit bytes; found when first asked for."""

    def __init__(self, library, before: str = "", bare: Ids | None = None):
        self.library, self.before, self.bare = library, before, self if bare is None else bare
        self.signs = byte_signs()
        self.first = "".join(self.signs[b] for b in before.encode())

    def _word(self, letters: str) -> bytes:
        # letters are one pre-token, so the model is asked for it alone
        signs = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.signs)
        return array("I", [t.id for t in self.library.model.tokenize(self.first + signs)]).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        plain = _words.match(chunk)
        if plain is None:
            found = array("I", self.library.encode(self.before + chunk, add_special_tokens=False).ids).tobytes()
        else:
            letters, marks, line = plain.groups()
            found = self._word(letters) if marks is None else self[letters] + self.bare[marks]
            if line:
                found = (self[letters] if marks is None else found) + self.bare["\n"] + self.bare[line]
        if len(chunk) <= LONGEST_KEPT:
            self[chunk] = found
        return found


class ChunkIds:
    """The ids of texts as little-endian 32-bit bytes; each distinct chunk is encoded once.

    Chunks are for byte-level vocabularies that cut before blanks; texts that hold a
    special token's string, and all texts of other vocabularies, go to the library whole.
    """

    def __init__(self, model: bytes):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model.decode())
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        kind = json.loads(model)
        cutter = kind.get("pre_tokenizer") or {}
        self.by_chunk = kind.get("normalizer") is None and (cutter.get("type"), cutter.get("use_regex"), cutter.get("add_prefix_space")) == ("ByteLevel", True, False)
        self.bare = Ids(self.library)
        self.after_blank = Ids(self.library, " ", self.bare)

    def of(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if not self.by_chunk or any(s in text for s in self.special):
                yield array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
                continue
            for table in (self.bare, self.after_blank):
                if len(table) > TABLE_ROWS:
                    table.clear()
            first, *others = chunks(text)
            yield self.bare[first] + b"".join(map(self.after_blank.__getitem__, others))


@functools.lru_cache(maxsize=1)
def _chunk_ids(model: bytes) -> ChunkIds:
    """One table for all tasks of a worker, as workers outlive tasks."""
    return ChunkIds(model)


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: the first may be shorter, the others are full."""
    head = n % capacity or min(n, capacity)
    return [(0, head)] + [(at, capacity) for at in range(head, n, capacity)]


def cut_pieces(docs: DataFrame, model_path: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Per piece: doc_id, piece (from 0), start, length, ids_crc32 and, if asked for, ids.

    A document's ids are the vocabulary's, strings of special tokens treated as the
    library does, then ``END_ID``: a null or empty text is one piece of that id
    alone. Repeated rows are pieces of their own. Only a document of more than
    ``capacity`` ids is cut.
    """
    model = read_model(model_path)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _chunk_ids(model)
        for batch in batches:
            for part in slices(batch, "text"):
                rows: dict[str, list] = {f.name: [] for f in schema}
                ids = library.of([t or "" for t in part.column("text").to_pylist()])
                for doc_id, data in zip(part.column("doc_id").to_pylist(), ids, strict=True):
                    data += end
                    for number, (start, length) in enumerate(pieces_of(len(data) // 4, capacity)):
                        own = data[4 * start : 4 * (start + length)]
                        for name, value in (("doc_id", doc_id), ("piece", number), ("start", start), ("length", length), ("ids_crc32", zlib.crc32(own))):
                            rows[name].append(value)
                        if with_ids:
                            rows["ids"].append(np.frombuffer(own, "<i4"))
                yield from as_batches([rows], schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_arrow(needed(docs, doc_id="long", text="string"), run, ddl)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths, each at most as often as ``counts`` has it, whose sum is the largest up to ``room``; long ones preferred.

    Bit s of a set says that the sum s can be reached. Lengths are added in rising
    order, and going back from the last, as many of each are taken as leave a sum
    that the lengths before it reach.
    """
    every, reach, seen = (1 << room + 1) - 1, 1, []
    for length in sorted(counts):
        if length > room:
            break
        left, step = min(counts[length], room // length), 1
        if not left:
            continue
        seen.append((length, left, reach))
        while left:
            step = min(step, left)
            reach |= reach << step * length & every
            left -= step
            step *= 2
    total, taken = reach.bit_length() - 1, {}
    for length, most, before in reversed(seen):
        for times in range(min(most, total // length), -1, -1):
            if before >> total - times * length & 1:
                if times:
                    taken[length] = times
                total -= times * length
                break
    return taken


@dataclass
class Plan:
    """Where the pieces of each length go, by rank: from ``ranks[i]`` on in pattern i's run of sequences."""

    ranks: np.ndarray
    lengths: np.ndarray
    base: np.ndarray
    times: np.ndarray
    offsets: np.ndarray
    n_sequences: int

    def place(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces of these ranks, counted from 0 in the order of length."""
        i = np.searchsorted(self.ranks, rank, "right") - 1
        copy, nth = np.divmod(rank - self.ranks[i], self.times[i])
        return self.base[i] + copy, self.offsets[i] + nth * self.lengths[i]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Minimum bin slack over counts by length; the plan has at most a few patterns for each length."""
    left = {length: n for length, n in counts.items() if n}
    order = sorted(left)
    first = dict(zip(order, np.cumsum([0, *(left[k] for k in order)]).tolist(), strict=False))
    used, rows, base = dict.fromkeys(order, 0), [], 0
    while order:
        seed = order[-1]
        rest = dict(left)
        rest[seed] -= 1
        taken = fullest(rest, capacity - seed)
        taken[seed] = taken.get(seed, 0) + 1
        copies = min(left[k] // n for k, n in taken.items())
        offset = 0
        for k, n in sorted(taken.items(), reverse=True):
            rows.append((first[k] + used[k], k, base, n, offset))
            offset += n * k
            used[k] += n * copies
            left[k] -= n * copies
            if not left[k]:
                del left[k]
                del order[bisect_right(order, k) - 1]
        base += copies
    columns = [np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)] if rows else [np.zeros(0, np.int64)] * 5
    return Plan(*columns, base)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to ``pieces``, whose length is from 1 to ``capacity``; other columns stay.

    Sequences are filled without gaps from offset 0, in as few of them as the plan
    reaches. The driver sees one count for each length. No pieces give no rows.
    """
    kept = saved(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {int(r.length): int(r.n) for r in kept.groupBy("length").agg(F.count("*").alias("n")).collect()}
    made = plan(counts, capacity)
    ranked = numbered(kept, ["length", "_row"], "_rank", 0)
    schema = pa.schema([(f.name, f.type) for f in _arrow(pieces)] + [("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = made.place(batch.column("_rank").to_numpy())
            own = [batch.column(f.name).cast(f.type) for f in schema if f.name not in ("sequence_id", "offset")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence), pa.array(offset)], schema=schema)

    columns = [f"`{c}`" for c in pieces.columns]
    ddl = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.select(*columns, "_rank").mapInArrow(run, ddl)


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def pack_documents(docs: DataFrame, model_path: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their sequences; see ``cut_pieces`` and ``pack``."""
    return pack(cut_pieces(docs, model_path, capacity, with_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids and the pieces' lengths of each packed sequence; a group is one sequence, so at most its capacity."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "ids", "length")))
    return packed.groupBy("sequence_id").agg(rows.alias("rows")).select("sequence_id", F.flatten(F.transform("rows", lambda r: r["ids"])).alias("ids"), F.transform("rows", lambda r: r["length"]).alias("lengths"))
