"""Benchmark decontamination with a generalised suffix automaton over words.

The normalised test items are built into one automaton of words. The words of
the training texts are streamed through it, keeping the longest run of words
that ends at the current place and occurs in some item. Where that run reaches a
window (``window`` words of an item, or the whole of a shorter one), the
window's words are hit and the items that hold it are noted. Only runs of words
that the items know, at least as long as the shortest window, are streamed; a
window can't lie anywhere else.

The items are test sets, whose size doesn't follow the corpus. Their words are
counted first: up to ``shard_words`` one automaton serves (some 100 MB at the
default, as it has at most two states a word), beyond it items are dealt over
several, each a pass of its own, and the hits are put together. An item that is
long by itself is cut into pieces that overlap by a window less a word, so no
window is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.columns import needed
from lattica.llm.textscan import NOT_ALNUM, Words, as_batches, map_arrow, slices, text_bytes
from lattica.session import cut, saved

#: Words of items that one automaton takes, and of one piece of an item.
SHARD_WORDS, PIECE_WORDS = 200_000, 10_000


class ItemAutomaton:
    """Generalised suffix automaton of items (lists of word hashes), with the windows that each state stands for."""

    def __init__(self, items: dict[str, list[list[int]]], window: int):
        self.window = window
        words = sorted({w for texts in items.values() for t in texts for w in t})
        self.vocabulary = np.array(words, np.uint64)
        number = {w: k for k, w in enumerate(words)}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [number[w] for w in t]) for item, texts in items.items() for t in texts if t]
        for _, text in coded:
            last = 0
            for w in text:
                last = self._extend(last, w)
        self.least = min((min(window, len(t)) for _, t in coded), default=window)
        n = len(self.length)
        # the state of the window that ends where a state's runs end
        self.full = [-1] * n
        for v in sorted(range(n), key=self.length.__getitem__):
            if self.length[v] >= window:
                up = self.link[v]
                self.full[v] = self.full[up] if self.length[up] >= window else v
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, set[str]] = {}
        for item, text in coded:
            v = 0
            for w in text:
                v = self.next[v][w]
                if self.full[v] >= 0:
                    self.items.setdefault(self.full[v], set()).add(item)
            if len(text) < window:
                self.short.setdefault(v, set()).add(item)
        # short items that end where a state's runs end, longest first
        self.ends: dict[int, tuple[tuple[int, int], ...]] = {}
        for v in sorted(range(1, n), key=self.length.__getitem__):
            own = ((self.length[v], v),) if v in self.short else ()
            if every := own + self.ends.get(self.link[v], ()):
                self.ends[v] = every
        # what streaming needs, flat: one table of moves, and arrays
        self.moves = {v * len(words) + w: to for v, after in enumerate(self.next) for w, to in after.items()}
        self.link, self.length, self.full = (np.array(x, np.int32) for x in (self.link, self.length, self.full))
        del self.next

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new = self._state({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _state(self, after: dict[int, int], length: int, link: int) -> int:
        self.next.append(after)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def stream(self, run: list[int], at: int, hits: list[tuple[int, int]], found: set[str]) -> None:
        """Follow a run of known words from word ``at`` of its text; append (first, after last) word of hit windows."""
        v = length = 0
        moves, n = self.moves, len(self.vocabulary)
        for k, w in enumerate(run, at + 1):
            to = moves.get(v * n + w, -1)
            while to < 0 and v:
                v = int(self.link[v])
                length = int(self.length[v])
                to = moves.get(v * n + w, -1)
            if to >= 0:
                v = to
                length += 1
            if length >= self.window:
                hits.append((k - self.window, k))
                found |= self.items[int(self.full[v])]
            for size, state in self.ends.get(v, ()):
                if length >= size:
                    hits.append((k - size, k))
                    found |= self.short[state]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans put together, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, piece, text (words joined by blanks) and n_words of the items, long ones cut into overlapping pieces."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    step = max(1, PIECE_WORDS - window + 1)
    worded = benchmark.where("text is not null").select("item_id", words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(step))
    cuts = worded.select("item_id", "w", F.posexplode(starts).alias("piece", "at"))
    return cuts.select("item_id", "piece", F.slice("w", F.col("at") + 1, PIECE_WORDS).alias("w")).select("item_id", "piece", F.array_join("w", " ").alias("text"), F.size("w").alias("n_words"))


def _items(pieces: DataFrame) -> dict[str, list[list[int]]]:
    """The pieces' word hashes by item; collected after their words were counted."""
    items: dict[str, list[list[int]]] = {}
    for row in pieces.collect():
        words = Words(*text_bytes(pa.array([row["text"]], pa.string())), NOT_ALNUM)
        items.setdefault(str(row["item_id"]), []).append(words.hashes().tolist())
    return items


Found = tuple[np.ndarray, list[list[int]], list[list[int]], list[list[str]]]


def _found(column: pa.Array, auto: ItemAutomaton) -> Found:
    """n_words, begins and ends of hit runs of words (merged), and the items found, of each text."""
    words = Words(*text_bytes(column), NOT_ALNUM)
    hashes, vocabulary = words.hashes(), auto.vocabulary
    n = np.diff(words.bounds)
    spans: list[list[tuple[int, int]]] = [[] for _ in n]
    items: list[set[str]] = [set() for _ in n]
    if len(vocabulary) and len(hashes):
        code = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        known = vocabulary[code] == hashes
        edge = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
        # runs end where a text ends, too
        cuts = np.unique(np.concatenate([edge, words.bounds]))
        first, last = cuts[:-1], cuts[1:]
        long = (last - first >= auto.least) & known[np.minimum(first, len(known) - 1)]
        for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True):
            i = int(words.doc[a])
            auto.stream(code[a:b].tolist(), a - int(words.bounds[i]), spans[i], items[i])
    runs = [merged(x) for x in spans]
    return n, [[a for a, _ in r] for r in runs], [[b for _, b in r] for r in runs], [sorted(x) for x in items]


def _hits(texts: DataFrame, automaton: ItemAutomaton) -> DataFrame:
    """The rows of ``texts`` (with text) and what ``_found`` finds in each."""
    added = [("n_words", pa.int64()), ("begins", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]
    shared = texts.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = _found(part.column("text"), shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(x, kind) for x, (_, kind) in zip(found, added, strict=True)]], names=[*part.schema.names, *[name for name, _ in added]])

    kept = ", ".join(f"{name} {kind}" for name, kind in texts.dtypes)
    return map_arrow(texts, run, f"{kept}, n_words long, begins array<long>, ends array<long>, items array<string>")


def _automata(benchmark: DataFrame, window: int, shard_words: int) -> tuple[int, Iterator[ItemAutomaton]]:
    """How many automata hold all items, as few as their words allow, and one after another of them: each is built when it is asked for."""
    pieces = _pieces(needed(benchmark, item_id="string", text="string"), window)
    total = pieces.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_words))
    mine = lambda k: pieces if shards == 1 else pieces.where(F.pmod(F.xxhash64("item_id", "piece"), F.lit(shards)) == k)
    return shards, (ItemAutomaton(_items(mine(k)), window) for k in range(shards))


def _carrying(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, shard_words: int = SHARD_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, begins and ends (the hit runs of words, merged), items, and the columns to ``carry`` as a struct ``carried``.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z
    lower-cased. An item of fewer words than ``window`` is one window; an item
    without words has none. A null text has no words; an item_id that comes twice
    counts once, a null one as 'None'. Repeated rows each get their own result.
    """
    texts = needed(docs, doc_id="long", text="string") if not carry else _carrying(docs, carry)
    out = ["doc_id", "n_words", "begins", "ends", "items", *["carried"] * bool(carry)]
    n, automata = _automata(benchmark, window, shard_words)
    if n == 1:
        return _hits(texts, next(automata)).select(*out)
    # every pass has to know a row by the same key
    keyed = cut(texts.withColumn("row_key", F.monotonically_increasing_id()))
    passes = None
    for automaton in automata:
        # written before the next automaton is built, so that the driver holds one at a time
        part = saved(_hits(keyed.select("row_key", "text"), automaton).drop("text"), "hits")
        passes = part if passes is None else passes.union(part)
    together = passes.groupBy("row_key", "n_words").agg(
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("begins", "ends")))).alias("runs"),
        F.array_distinct(F.array_sort(F.flatten(F.collect_list("items")))).alias("items"),
    )
    merged = F.expr("""aggregate(runs, cast(array() as array<struct<begins:bigint,ends:bigint>>), (done, r) ->
        if(size(done) > 0 and r.begins <= element_at(done, -1).ends,
           concat(slice(done, 1, size(done) - 1), array(named_struct('begins', element_at(done, -1).begins, 'ends', greatest(element_at(done, -1).ends, r.ends)))),
           concat(done, array(r))))""")
    rows = together.withColumn("runs", merged).withColumns({"begins": F.col("runs.begins"), "ends": F.col("runs.ends")})
    return keyed.drop("text").join(rows, "row_key").select(*out)


def judge(found: DataFrame, least_percent: int = 5) -> DataFrame:
    """Add n_hit, n_items, items_sha256 and contaminated (hit words make up ``least_percent`` of the words at least)."""
    n_hit = F.aggregate(F.zip_with("begins", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    more = [c for c in found.columns if c == "carried"]
    return found.withColumn("n_hit", n_hit).select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= least_percent * F.col("n_words"))).alias("contaminated"),
        *more,
    )


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 13, max_run: int = 13, max_percent: int = 5, columns: tuple[str, ...] = (), drop_contaminated: bool = False, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, text and the named ``columns`` of every row, without the hit runs of more than ``max_run`` words, or
    without all hit runs where they make up ``max_percent`` of the words or more; and n_cut, the words taken out.

    With ``drop_contaminated`` rows over the percentage go altogether. Each row is
    judged and cut by itself, in one pass, however often its doc_id comes. Words
    keep their places; what stands between the removed words goes with them. A
    null text stays null.
    """
    carry = ("text", *[c for c in columns if c not in ("doc_id", "text")])

    def clean(texts: list[str | None], found: Found) -> tuple[list[str | None], list[int], list[bool]]:
        """Texts without the runs that go, how many words went, and which rows stay."""
        n_cut, stays = [0] * len(texts), [True] * len(texts)
        for i, (text, n, begins, ends) in enumerate(zip(texts, *found[:3], strict=True)):
            runs = list(zip(begins or (), ends or (), strict=True))
            n_hit = sum(b - a for a, b in runs)
            over = n_hit > 0 and 100 * n_hit >= max_percent * n
            stays[i] = not (over and drop_contaminated)
            runs = runs if over else [(a, b) for a, b in runs if b - a > max_run]
            if text and runs:
                raw = text.encode()
                words = Words(*text_bytes(pa.array([text])), NOT_ALNUM)
                for a, b in reversed(runs):
                    raw = raw[: words.starts[a]] + raw[words.ends[b - 1] :]
                    n_cut[i] += b - a
                texts[i] = raw.decode()
        return texts, n_cut, stays

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[f"`{c}`" for c in carry[1:]])
    ddl = ", ".join(f"`{name}` {kind}" for name, kind in kept.dtypes) + ", n_cut long"
    names = [*kept.columns, "n_cut"]

    def batch_of(part: pa.RecordBatch, found: Found) -> pa.RecordBatch:
        texts, n_cut, stays = clean(part.column("text").to_pylist(), found)
        columns = [pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in names[:-1]]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n_cut, pa.int64())], names=names).filter(pa.array(stays, pa.bool_()))

    n, automata = _automata(benchmark, window, shard_words)
    if n == 1:
        shared = docs.sparkSession.sparkContext.broadcast(next(automata))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    yield batch_of(part, _found(part.column("text"), shared.value))

        return map_arrow(kept, run, ddl)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield batch_of(part, tuple(part.column(c).to_pylist() for c in ("_n", "_begins", "_ends", "_items")))

    found = find_contamination(docs, benchmark, window, shard_words, carry)
    flat = found.select("doc_id", "carried.*", *[F.col(c).alias(f"_{c}") for c in ("begins", "ends", "items")], F.col("n_words").alias("_n"))
    return map_arrow(flat, second, ddl)
