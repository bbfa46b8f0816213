"""Packing by minimum bin slack: ids as the library has them, whole pieces, full sequences."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lattica.llm import packing
from lattica.llm.queries import byte_vocabulary, op11_bin_slack

ODD = [None, "", " ", "   ", "\n\n x", "a  b", "a \n b ", "x<|endoftext|> y", "é ñ😀 中文　x", "don't we'll", "x" * 3000, " lead", "1 2²½"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_vocabulary())


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 5, "clash") for i, t in rows], "doc_id long, text string, offset long, piece string")


def test_chunks_encode_like_whole_texts(library):
    rng = random.Random(3)
    signs = [" ", " ", "  ", "\n", "\t", "a", "B", "é", "1", "½", "!", "　", "\x1c", "\x85", "​", "'s", "<|endoftext|>", "﻿"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(14))) for _ in range(5000)]
    ids = packing.ChunkIds(open(byte_vocabulary(), "rb").read())
    assert [np.frombuffer(b, "<u4").tolist() for b in ids.of(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def check(library, rows, found, capacity):
    """Pieces are those of the rows, sequences have no gap and none is over capacity."""
    want = Counter()
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        head = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        at = [0, *range(head, len(ids), capacity)]
        want.update((i, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())) for k, (s, e) in enumerate(zip(at, [*at[1:], len(ids)], strict=True)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


def test_packed_documents(spark, library):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("con", "ter", "lo") for b in ("tion", "x", "ving")]
    rows = list(enumerate(ODD)) + [(100 + i, " ".join(rng.choices(words, k=rng.randint(1, 150)))) for i in range(150)]
    rows += [rows[-1], (None, "no id"), (None, None), (100, "again one id")]
    packed = packing.pack_documents(documents(spark, rows), byte_vocabulary(), 128)
    found = packed.collect()
    n = check(library, rows, found, 128)
    assert n <= -(-sum(r.length for r in found) // 128) + 1
    for r in packing.sequences(packed).collect():
        assert sum(r.lengths) == len(r.ids) <= 128
    by_place = {(r.sequence_id, r.offset): list(r.ids) for r in found}
    for r in packing.sequences(packed).collect():
        assert by_place[r.sequence_id, 0] == list(r.ids)[: r.lengths[0]]


def test_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    found = op11_bin_slack(spark, sf).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert check(library, rows, found, 2048) <= -(-sum(r.length for r in found) // 2048) + 1


def test_no_documents(spark):
    assert packing.pack_documents(documents(spark, []), byte_vocabulary()).collect() == []


def test_fullest_is_the_best_sum():
    rng = random.Random(1)
    for _ in range(300):
        counts, room = {rng.randint(1, 25): rng.randint(0, 4) for _ in range(rng.randint(0, 6))}, rng.randint(0, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        taken = packing.fullest(counts, room)
        assert all(0 < n <= counts[k] for k, n in taken.items())
        assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= room)


def test_plan_places_each_piece_once():
    rng = random.Random(2)
    for _ in range(60):
        counts = {rng.randint(1, 40): rng.randint(1, 60) for _ in range(rng.randint(1, 12))}
        made = packing.plan(counts, 40)
        lengths = np.repeat(sorted(counts), [counts[k] for k in sorted(counts)])
        sequence, offset = made.place(np.arange(len(lengths)))
        assert made.n_sequences == len(set(sequence.tolist())) <= len(lengths)
        spots = {(s, o + d) for s, o, n in zip(sequence, offset, lengths, strict=True) for d in range(n)}
        assert len(spots) == lengths.sum() and max(d for _, d in spots) < 40
        # copies of one pattern are one entry: the plan doesn't grow with the counts
        assert len(made.ranks) == len(packing.plan({k: n * 1000 for k, n in counts.items()}, 40).ranks) or len(made.ranks) <= 40 * 40


def test_pieces_of():
    assert packing.pieces_of(1, 4) == [(0, 1)] and packing.pieces_of(4, 4) == [(0, 4)]
    assert packing.pieces_of(9, 4) == [(0, 1), (1, 4), (5, 4)] and packing.pieces_of(8, 4) == [(0, 4), (4, 4)]
