"""Personal data: base patterns, and a character-level bidirectional LSTM with a CRF that adds what they miss.

The tagger is trained in numpy from labelled spans: emails, addresses, cards and
phone numbers, plain and disguised, and look-alikes that are none, planted in
stretches of a bounded sample of the corpus. Texts are cut into overlapping
windows; the CRF decodes each, and a span belongs to the window in whose core it
begins, so every place is judged once and with context on both sides. A span that
comes near the end of its window goes on in the next one, and so forth, so spans
of any length come out whole. The spans of a text are then reconciled: a span that
touches a base span or a better scored one goes, and so does one whose characters
can't be of its kind.

A span that can be of a kind holds a digit, an @, a spelled-out "at" or "dot", or
a colon before a colon or a hex digit (an address such as dead:beef::cafe); every
window that holds one of these is decoded, and so are those that a span may have
come from or go on into. The others are not, as no span of theirs could stay.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.columns import needed
from lattica.llm.recurrent import Tagger, viterbi
from lattica.llm.textscan import as_batches, map_arrow, slices

KINDS = ("email", "ip", "card", "phone")
#: Characters in a window, and in its core, which begins a quarter of the window in.
WINDOW, CORE = 128, 64
#: Where a span leaves its window for the next one: both have context around this place.
LEAVE = WINDOW - CORE // 4
#: Documents whose stretches carry the training spans, and windows made from them.
TRAIN_DOCUMENTS, TRAIN_WINDOWS = 300, 2048

#: The base patterns.
_email_tail = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_email_head = re.compile(r"[A-Za-z0-9._%+-]")
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_HEAD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: What every span that can be of a kind holds; a spelled-out word counts from its first letter.
_trigger = re.compile(r"(?i)[0-9@]|:(?=[0-9a-f:])|(?<=[\[( ])(?:at|dot)(?=[\]) ])")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base matches, by kind, then start; leftmost and non-overlapping for each kind."""
    spans: list[tuple[int, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _HEAD:
            start -= 1
        tail = _email_tail.match(text, at) if start < at else None
        if tail:
            spans.append((0, start, tail.end()))
            done = tail.end()
        at = text.find("@", max(at + 1, done))
    if re.search("[0-9]", text):
        spans += [(1, *m.span()) for m in _ip.finditer(text) if max(map(_part, m[0].split("."))) <= 255]
        spans += [(2, *m.span()) for m in _card.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        spans += [(3, *m.span()) for m in _phone.finditer(text) if 8 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return spans


def _part(digits: str) -> int:
    """The value of a part of an address; a part of many digits is only known to be large."""
    digits = digits.lstrip("0")
    return int(digits or "0") if len(digits) < 5 else 99999


def codes(text: str) -> np.ndarray:
    """Character classes of the tagger: ASCII characters, other letters, anything else."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, points, np.where(points < 0x2000, 128, 129)).astype(np.int16)


PAD, SYMBOLS, TAGS = 130, 131, 1 + 2 * len(KINDS)

#: How spans of each kind are written in training, and look-alikes (None). # is a digit, w a word, h a hex digit, b a number up to 255.
_FORMS = [
    (0, "w.##@w#.w.com"), (0, "w@w.org"), (0, "w-w@w.net"), (0, "w (at) w (dot) com"), (0, "w [at] w [dot] org"), (0, "w at w dot com"), (0, "w.w at w dot net"),
    (1, "b.b.b.b"), (1, "b.b.b.b"), (1, "hhhh:hhhh:hhhh:hhhh:hhhh:hhhh:hhhh:hhhh"), (1, "hhhh:hhhh::hhhh:hhhh"),
    (2, "C"), (2, "C"), (2, "C4 "), (2, "C4-"), (2, "C4."),
    (3, "+# (###) ###-####"), (3, "+## ### #######"), (3, "(###) ###-####"), (3, "###-###-####"), (3, "00## ## #######"), (3, "+# (###) ###-####"),
    (None, "20##-0#-1#"), (None, "#.#."), (None, "version #.#"), (None, "##.##"), (None, "######"), (None, "hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh"), (None, "@w"), (None, "w at w"), (None, "$###,###"), (None, "##:##"), (None, "########################"), (None, "#.#.#"),
]


def _write(form: str, words: list[str], rng: np.random.Generator) -> str:
    if form[0] == "C":
        digits = "".join(map(str, rng.integers(0, 10, 15)))
        digits += next(str(d) for d in range(10) if luhn(digits + str(d)))
        return form[2].join(digits[k : k + 4] for k in range(0, 16, 4)) if form[1:] else digits
    made = {"#": lambda: str(rng.integers(10)), "h": lambda: "0123456789abcdef"[rng.integers(16)], "b": lambda: str(rng.integers(256)), "w": lambda: words[rng.integers(len(words))]}
    return re.sub(r"#|(?<![a-gi-z])h(?![a-gi-z])|\bw\b|\bb\b", lambda m: made[m[0]](), form.replace("hhhh", "h" * 4))


def labelled_windows(carriers: list[str], count: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training windows (symbols, mask, tags), each (WINDOW / 2, count): carriers with labelled spans planted in them."""
    rng, width = np.random.default_rng(seed), WINDOW // 2
    carriers = [c for c in carriers if c.strip()] or ["the of and to in a is that"]
    words = sorted({w for c in carriers for w in re.findall("[a-z]{2,9}", c.lower())})[:5000] or ["word"]
    x, tags = np.full((width, count), PAD, np.int16), np.zeros((width, count), np.int64)
    for n in range(count):
        text = carriers[rng.integers(len(carriers))]
        at = int(rng.integers(max(1, len(text) - 40)))
        out, marks = text[at : at + int(rng.integers(0, 24))], []
        while len(out) < width:
            if rng.random() < 0.75:
                kind, form = _FORMS[rng.integers(len(_FORMS))]
                span = _write(form, words, rng)
                out += rng.choice([" ", " ", " ", "\n", "*** ", ": ", "("])
                if kind is not None:
                    marks.append((kind, len(out), len(out) + len(span)))
                out += span + str(rng.choice([" ", " ", " ", ".", ",", "###", "!! ", ")"]))
            at = int(rng.integers(max(1, len(text) - 40)))
            out += text[at : at + int(rng.integers(4, 30))]
        own = codes(out)[:width]
        x[: len(own), n] = own
        for kind, a, b in marks:
            tags[a : min(b, width), n] = 2 + 2 * kind
            if a < width:
                tags[a, n] = 1 + 2 * kind
    return x, x != PAD, tags


def train(docs: DataFrame, documents: int = TRAIN_DOCUMENTS, windows: int = TRAIN_WINDOWS, epochs: int = 6, seed: int = 11) -> Tagger:
    """Train the tagger on spans planted in the first KB of ``documents`` texts, picked by hash of their id."""
    texts = needed(docs, doc_id="long", text="string").where("doc_id is not null and text is not null and text != ''")
    # ids are picked first, so that what meets for the pick is small
    picked = texts.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents).distinct()
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.substring("text", 1, 1000)).alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    tagger = Tagger(12, 16, TAGS, SYMBOLS, seed)
    tagger.fit(*labelled_windows([r["text"] for r in rows], windows, seed), epochs=epochs, batch=48, rate=0.03)
    return tagger


_can_be = (
    re.compile(r"(?i)[\w.%+-]+ ?(?:@|\(at\)|\[at\]| at ) ?[\w-]+(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[\w-]+)+"),
    None,
    re.compile(r"[0-9](?:[ .-]?[0-9])+"),
    re.compile(r"(?:00 ?)?\(?[0-9][ ().0-9-]+[0-9]"),
)


def possible(kind: int, span: str) -> bool:
    """Whether the characters of a tagged span can be of its kind."""
    if kind == 1:
        try:
            return ":" in span and bool(ipaddress.IPv6Address(span))
        except ValueError:
            return False
    if not _can_be[kind].fullmatch(span):
        return False
    digits = _digits(span)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1
    return kind == 0 or 9 <= len(digits) <= 15 and bool(re.search(r"[ ()-]", span)) and not re.match(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", span)


def _end(tags: list[int], at: int, inside: int) -> int:
    """Where the run of ``inside`` that holds or begins at ``at`` ends."""
    while at < WINDOW and tags[at] == inside:
        at += 1
    return at


def tagged_spans(tagger: Tagger, texts: list[str], gated: bool = True) -> list[list[tuple[int, int, int, float]]]:
    """(kind, start, end, score) of the tagger's spans in each text: windows decoded side by side, each span from the window in whose core it begins.

    A span that comes to LEAVE in its window goes on where the next window has that
    place, if that one has it inside of the same kind, too. With ``gated``
    only windows that hold a trigger are decoded, and their neighbours that share a
    span with them.
    """
    symbols: dict[int, np.ndarray] = {}
    held: dict[tuple[int, int], tuple[list[int], np.ndarray] | None] = {}
    wanted: list[tuple[int, int]] = []
    for k, text in enumerate(texts):
        at = [m.start() for m in _trigger.finditer(text)] if gated else range(len(text))
        if not at:
            continue
        symbols[k] = codes(text)
        # a place is in the windows of two cores
        core = np.unique(np.concatenate([(np.array(at) + d) // CORE for d in (-CORE // 2, CORE // 2)]))
        wanted += [(k, c) for c in core[(core >= 0) & (core * CORE < len(text))].tolist()]
    while wanted:
        near: set[tuple[int, int]] = set()
        for at in range(0, len(wanted), 1024):
            some = wanted[at : at + 1024]
            x = np.full((len(some), WINDOW), PAD, np.int16)
            for n, (k, c) in enumerate(some):
                a = c * CORE - CORE // 2
                own = symbols[k][max(0, a) : a + WINDOW]
                x[n, max(0, -a) : max(0, -a) + len(own)] = own
            x = x.T
            mask = x != PAD
            scores = tagger.scores(x, mask)
            path = viterbi(scores, mask, tagger.p["moves"])
            margin = np.take_along_axis(scores, path[:, :, None], 2)[:, :, 0] - scores[:, :, 0]
            held.update(dict.fromkeys(some))
            for n in np.flatnonzero((path > 0).any(0)).tolist():
                k, c = some[n]
                tags = path[:, n].tolist()
                held[k, c] = tags, margin[:, n].copy()
                if tags[LEAVE - CORE] > 0 and tags[LEAVE - CORE] % 2 == 0 and c > 0:
                    near.add((k, c - 1))
                if tags[LEAVE - 1] > 0 and (c + 1) * CORE < len(texts[k]):
                    near.add((k, c + 1))
        wanted = sorted(near - held.keys())
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    for (k, c), window in sorted((w, v) for w, v in held.items() if v):
        tags, a, t = window[0], c * CORE - CORE // 2, CORE // 2
        while t < CORE // 2 + CORE:
            tag = tags[t]
            begins = tag > 0 and (tag % 2 == 1 or tags[t - 1] not in (tag, tag - 1))
            if begins:
                inside, (run, margin), first, at, total = (tag + 1) // 2 * 2, window, t, c, 0.0
                end = _end(run, t + 1, inside)
                while end >= LEAVE and (after := held.get((k, at + 1))) and after[0][LEAVE - CORE] == inside:
                    total += float(margin[first:LEAVE].sum())
                    (run, margin), first, at = after, LEAVE - CORE, at + 1
                    end = _end(run, first, inside)
                total += float(margin[first:end].sum())
                end += (at - c) * CORE
                found[k].append((inside // 2 - 1, a + t, a + end, total / (end - t)))
                t = end
            else:
                t += 1
    return found


def reconcile(text: str, base: list[tuple[int, int, int]], tagged: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Base spans, and tagged ones that are possible and touch neither a base span nor a better tagged one; by kind, then start."""
    starts, ends = [], []  # of what is taken: apart from each other and in order
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    spans = list(base)
    for kind, a, b, _ in sorted(tagged, key=lambda s: (-s[3], s[1])):
        b = min(b, len(text))
        while a < b and text[a] in " (\n":
            a += 1
        while b > a and text[b - 1] in " .,\n":
            b -= 1
        whole = not (text[a - 1 : a].isalnum() or text[b : b + 1].isalnum())
        at = bisect_left(starts, b)
        if a < b and whole and possible(kind, text[a:b]) and not (at and a < ends[at - 1]):
            starts.insert(at, a)
            ends.insert(at, b)
            spans.append((kind, a, b))
    return sorted(spans)


def find_personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, spans array<struct<kind, start, end, base>> by kind as listed, then start.

    Places are code points, ends exclusive; the whole text is searched. A null or
    empty text has no spans; repeated rows each get theirs. Spans of one kind
    don't overlap; tagged spans overlap no other span.
    """
    tagger = tagger or train(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                out = []
                for text, tagged in zip(texts, tagged_spans(tagger, texts), strict=True):
                    base = base_spans(text)
                    own = set(base)
                    out.append([{"kind": KINDS[k], "start": a, "end": b, "base": (k, a, b) in own} for k, a, b in (reconcile(text, base, tagged) if tagged else base)])
                yield from as_batches([{"doc_id": part.column("doc_id"), "spans": out}], schema)

    return map_arrow(needed(docs, doc_id="long", text="string"), run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, base_sha256 and spans of the results of ``find_personal_data``."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == F.lit(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def mask_spans(docs: DataFrame, tagger: Tagger | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text with every span replaced by its kind in angle brackets, n_masked, and the named ``columns`` as they are.

    Overlapping spans become one. A null text stays null.
    """
    tagger = tagger or train(docs)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                out, counts = [], []
                for text, tagged in zip(texts, tagged_spans(tagger, [t or "" for t in texts]), strict=True):
                    spans = sorted((a, b, k) for k, a, b in reconcile(text or "", base_spans(text or ""), tagged))
                    pieces, done, n = [], 0, 0
                    for a, b, k in spans:
                        if a >= done:
                            pieces += [text[done:a], f"<{KINDS[k].upper()}>"]
                            n += 1
                        done = max(done, b)
                    out.append("".join([*pieces, text[done:]]) if spans else text)
                    counts.append(n)
                arrays = [part.column("doc_id"), pa.array(out, pa.string()), pa.array(counts, pa.int64()), *[part.column(c) for c in columns]]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text", "n_masked", *columns])

    ddl = ", ".join(["doc_id long, text string, n_masked long", *[f"`{c}` {kinds[c]}" for c in columns]])
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *columns), run, ddl)
