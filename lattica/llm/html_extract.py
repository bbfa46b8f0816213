"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks: the text between block-level tags, with inline tags
taken out. Every block becomes a vector of its tag path (tags, classes and ids of
the open elements, hashed), its words (hashed) and a few measures; a
bidirectional LSTM in numpy reads the whole page's sequence of vectors, and a
CRF labels each block as main text or not. It is trained on a bounded sample of
the pages, labelled by their semantic containers, and on pages laid out at
random from the sample's words, whose labels are known.

A check follows: blocks in elements that never hold article text (scripts,
forms, navigation and the like) are left out whatever their label.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.columns import needed
from lattica.llm.recurrent import Tagger
from lattica.llm.textscan import NOT_ALNUM, U64, Words, as_batches, map_arrow, slices, text_bytes

#: Elements that break a text into blocks, that stand alone, whose content isn't text, and that never hold article text.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object".split())
SWALLOWS = frozenset("script style iframe".split())
NEVER = frozenset("head nav footer aside form button select textarea option dialog menu".split())
CLOSED_BY = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}

#: Sizes of the parts of a block's vector, and of the sample that the labeller is trained on.
PATH, WORDS, MEASURES = 48, 16, 6
TRAIN_PAGES, MADE_PAGES = 150, 450

_opening = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
_special = re.compile("[>\"']")
_named = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_piece = re.compile(r"[A-Za-z]+")


@lru_cache(maxsize=20_000)
def _marks(element: str) -> np.ndarray:
    """The hashed tag and names of an element (``tag names``), summed up."""
    v = np.zeros(PATH, np.float32)
    tag, _, names = element.partition(" ")
    for key in {tag, *(p.lower() for p in _piece.findall(names))}:
        v += _mark(key)
    return v


@lru_cache(maxsize=20_000)
def _mark(key: str) -> np.ndarray:
    v, h = np.zeros(PATH, np.float32), crc32(key.encode())
    v[h % PATH] += 1 if h >> 16 & 1 else -1
    v[(h >> 8) % PATH] += 1 if h >> 17 & 1 else -1
    return v


class Element:
    """An open element with the one around it; blocks share them, so a deep page costs no more than a wide one."""

    __slots__ = ("parent", "shown", "tag", "depth", "block", "linked", "main", "never", "formed", "form_since", "_sums")

    def __init__(self, parent: Element | None, shown: str):
        self.parent, self.shown = parent, shown
        self.tag = tag = shown.partition(" ")[0]
        self.depth: int = parent.depth + 1 if parent else 1
        #: The nearest block-level element, itself included; whether a link, article or main is around it.
        self.block: Element | None = self if tag in BLOCK else parent and parent.block
        self.linked: bool = tag == "a" or bool(parent and parent.linked)
        self.main: bool = tag in ("article", "main") or bool(parent and parent.main)
        #: Whether it lies in an element that never holds article text, forms apart; in any form; in a form that holds no article around it.
        self.never: bool = (tag in NEVER and tag != "form") or bool(parent and parent.never) or (tag == "header" and not (parent and parent.main))
        self.formed: bool = tag == "form" or bool(parent and parent.formed)
        self.form_since: bool = tag not in ("article", "main") and (tag == "form" or bool(parent and parent.form_since))
        self._sums: tuple | None = None

    def path(self) -> tuple[str, ...]:
        found, at = [], self
        while at:
            found.append(at.shown)
            at = at.parent
        return tuple(reversed(found))

    def sums(self) -> tuple[tuple[np.ndarray, str, int], ...]:
        """Summed marks, last tag and length of the path: whole, without forms around an article, and without forms."""
        chain, at = [], self
        while at and at._sums is None:
            chain.append(at)
            at = at.parent
        held = at._sums if at else ((np.zeros(PATH, np.float32), "", 0),) * 3
        for e in reversed(chain):
            more = lambda x: (x[0] + _marks(e.shown), e.tag, x[2] + 1)  # noqa: E731, B023
            whole, some, none = held
            if not e.formed:
                held = (more(whole),) * 3
            elif e.tag == "form":
                held = more(whole), more(some), none
            else:
                held = more(whole), more(none if e.tag in ("article", "main") else some), more(none)
            e._sums = held
        return held


WHOLE, SOME_FORMS, NO_FORMS = range(3)
Block = tuple[Element | None, str, float]


class _Tags:
    """Where the tags of a page end. A search that fails isn't made again from a place that it went through."""

    def __init__(self, page: str):
        self.page = page
        self.first, self.at = 0, -1  # from ``first`` on the next of > " ' stands at ``at``
        self.dead: set[int] = set()  # quotes outside of quotes from which no tag ends
        self.last = {q: page.rfind(q) for q in "\"'"}
        self.unclosed: set[str] = set()

    def end(self, at: int) -> int:
        """The place behind the > that ends a tag whose name ends at ``at``; -1 if none does."""
        page, gone = self.page, []
        while True:
            if not self.first <= at <= self.at:
                m = _special.search(page, at)
                self.first, self.at = at, m.start() if m else len(page)
            k = self.at
            if k < len(page) and page[k] == ">":
                return k + 1
            other = -1
            if k < len(page) and k not in self.dead:
                gone.append(k)
                other = page.find(page[k], k + 1) if k < self.last[page[k]] else -1
            if other < 0:
                self.dead.update(gone)
                return -1
            at = other + 1

    def find(self, sign: str, at: int) -> int:
        """Where ``sign`` stands next; -1 if nowhere."""
        k = -1 if sign in self.unclosed else self.page.find(sign, at)
        if k < 0:
            self.unclosed.add(sign)
        return k

    def closing(self, tag: str, at: int) -> int:
        """The place behind the next closing tag; -1 if there is none."""
        m = None if f"</{tag}" in self.unclosed else re.compile(f"</{tag}\\s*>", re.I).search(self.page, at)
        if not m:
            self.unclosed.add(f"</{tag}")
        return m.end() if m else -1


def blocks(page: str) -> list[Block]:
    """(innermost open element, text, share of its characters in links) of every block with text, in page order.

    Time and memory grow in proportion to the page, however deep or broken it is.
    """
    out: list[Block] = []
    top: Element | None = None
    opened: dict[str, list[Element]] = {}
    parts: list[str] = []
    place: Element | None = None
    linked = since = at = 0
    tags = _Tags(page)

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((place, text, min(1.0, linked / len(text))))
            parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal place, linked
        if text:
            if not parts:
                place = top
            parts.append(text)
            if top and top.linked:
                linked += len(text)

    def close(element: Element) -> None:
        nonlocal top
        while top is not element.parent:
            opened[top.tag].pop()
            top = top.parent

    while True:
        k = page.find("<", at)
        if k < 0:
            add(page[since:])
            flush()
            return out
        m = None
        if page.startswith("<!--", k):
            end = tags.find("-->", k + 4)
            end = end + 3 if end >= 0 else len(page)
        elif page.startswith(("<!", "<?"), k):
            end = tags.find(">", k + 2) + 1 or -1
        else:
            m = _opening.match(page, k)
            end = tags.end(m.end()) if m else -1
        if end < 0:  # no tag: plain text
            at = k + 1
            continue
        add(page[since:k])
        since = at = end
        if m is None:
            continue
        tag, inside = m[2].lower(), page[m.end() : end - 1]
        if m[1]:
            if tag in BLOCK:
                flush()
            if opened.get(tag):
                close(opened[tag][-1])
            continue
        if tag in RAW:
            if not inside.endswith("/"):
                end = tags.closing(tag, at)
                # what isn't closed takes the rest of the page only where a browser reads it as raw text
                since = at = end if end >= 0 else len(page) if tag in SWALLOWS else at
            continue
        if tag in BLOCK:
            flush()
            # only block-level elements are closed by others, so the nearest one decides
            if top and top.block and tag in CLOSED_BY.get(top.block.tag, ()):
                close(top.block)
        if tag in VOID:
            if tag == "br":
                add(" ")
            continue
        if inside.rstrip().endswith("/") and tag not in BLOCK:
            continue
        names = " ".join(a or b or c for _, a, b, c in _named.findall(inside)) if inside else ""
        top = Element(top, f"{tag} {names}" if names else tag)
        opened.setdefault(tag, []).append(top)


_OUTSIDE = (np.zeros(PATH, np.float32), "", 0)


def vectors(found: list[Block], forms: list[int] | int = WHOLE) -> np.ndarray:
    """A vector for each block; ``forms`` says, for each or for all, which forms count as part of its path."""
    n = len(found)
    v = np.zeros((n, PATH + WORDS + MEASURES), np.float32)
    if not n:
        return v
    words = Words(*text_bytes(pa.array([t for _, t, _ in found], pa.string())), NOT_ALNUM)
    h = words.hashes()
    sign = np.where(h >> U64(40) & U64(1), 1.0, -1.0)
    v[:, PATH : PATH + WORDS] = np.bincount(words.doc * WORDS + (h % U64(WORDS)).astype(np.int64), sign, n * WORDS).reshape(n, WORDS)
    count = np.bincount(words.doc, minlength=n)
    v[:, PATH : PATH + WORDS] /= np.sqrt(1 + count)[:, None]
    paths = [e.sums()[f] if e else _OUTSIDE for (e, _, _), f in zip(found, forms if isinstance(forms, list) else [forms] * n, strict=True)]
    v[:, :PATH] = [np.clip(marks + _mark("leaf:" + tag), -2, 2) if tag else marks for marks, tag, _ in paths]
    stops = np.array([t.count(".") + t.count(",") for _, t, _ in found])
    v[:, PATH + WORDS :] = np.stack([np.log1p(count) / 4, [share for _, _, share in found], np.log1p(stops) / 2, [t[-1] in ".!?\"" for _, t, _ in found], np.arange(n) / n, [min(length, 12) / 12 for _, _, length in paths]], 1)
    return v


def never(element: Element | None, forms: int = WHOLE) -> bool:
    """Whether a block lies in an element that never holds article text; of forms those count that ``forms`` names."""
    return bool(element) and (element.never or (element.formed, element.form_since, False)[forms])


def page_forms(found: list[Block]) -> int:
    """Which forms of a page say something about its blocks: none where most of the page stands in forms, else those around no article."""
    formed = sum(len(text) for e, text, _ in found if e and e.formed)
    return NO_FORMS if 2 * formed > sum(len(text) for _, text, _ in found) else SOME_FORMS


#: Names of containers in the pages made for training.
_GOOD = ["article", "main", 'div class="content"', 'div id="content"', 'div class="post-body"', 'div class="entry-content"', 'section class="story"', 'div class="article-text"', "div"]
_BAD = ["nav", "header", "footer", "aside", 'div class="ad"', 'div class="advert"', 'div class="ads banner"', 'div class="sidebar"', 'div id="menu"', 'div class="cookie-notice"', 'div class="notice"', 'div class="promo"', 'div class="related"', 'div class="share social"', 'div class="breadcrumbs"', 'ul class="menu"', 'div class="footer"', 'div id="header"', "form", 'div class="newsletter"', 'div class="copyright"']
_COMMENTS = ['div class="comments"', 'section id="comments"', 'div class="comment-list"', 'ol class="comments"']


def made_page(words: list[str], rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page laid out at random, and whether each of its blocks is main text."""
    out, marks = ["<html><body>"], []

    def say(n: int) -> str:
        return " ".join(words[k] for k in rng.integers(0, len(words), n)).capitalize()

    def prose() -> str:
        return ". ".join(say(int(rng.integers(3, 18))) for _ in range(int(rng.integers(1, 6)))) + "."

    def tagged(opening: str, body: str) -> str:
        return f"<{opening}>{body}</{opening.split()[0]}>"

    def put(body: str, main: bool) -> str:
        marks.append(main)
        return body

    def boilerplate() -> str:
        kind = _BAD[rng.integers(len(_BAD))]
        style = rng.random()
        if style < 0.4:
            return tagged(kind, "<ul>" + "".join(put(f'<li><a href="/x">{say(int(rng.integers(1, 4)))}</a></li>', False) for _ in range(int(rng.integers(2, 8)))) + "</ul>")
        if style < 0.7:
            return tagged(kind, "".join(put(f"<p>{prose() if rng.random() < 0.5 else say(4)}</p>", False) for _ in range(int(rng.integers(1, 4)))))
        return tagged(kind, put(f"&copy; {say(6)}" if rng.random() < 0.3 else prose(), False))

    def comments() -> str:
        one = lambda: tagged(["div", 'div class="comment"', "li", 'article class="comment"'][rng.integers(4)], put(f"<p>{say(2)}</p>", False) + put(f"<p>{prose()}</p>", False))
        return tagged(_COMMENTS[rng.integers(len(_COMMENTS))], put(f"<h3>{say(2)}</h3>", False) + "".join(one() for _ in range(int(rng.integers(1, 6)))))

    for _ in range(int(rng.integers(1, 5))):
        out.append(boilerplate())
    body = [put(f"<h1>{say(int(rng.integers(2, 10)))}</h1>", True)] if rng.random() < 0.9 else []
    for _ in range(int(rng.integers(1, 14))):
        kind = rng.random()
        if kind < 0.72:
            body.append(put(f"<p>{prose() if rng.random() < 0.85 else say(2)}</p>" if rng.random() < 0.9 else f"<p><b>{say(5)}<br>", True))
        elif kind < 0.8:
            body.append(put(f"<h2>{say(3)}</h2>", True))
        elif kind < 0.87:
            body.append("<ul>" + "".join(put(f"<li>{say(6)}</li>", True) for _ in range(int(rng.integers(2, 5)))) + "</ul>")
        elif kind < 0.93:
            body.append(put(f"<blockquote>{prose()}</blockquote>", True))
        else:
            body.append(boilerplate())
    if rng.random() < 0.15:
        body.append(comments())
    out.append(tagged(_GOOD[rng.integers(len(_GOOD))], "".join(body)))
    if rng.random() < 0.35:
        out.append(comments())
    for _ in range(int(rng.integers(1, 5))):
        out.append(boilerplate())
    return "".join([*out, "</body></html>"]), marks


_boiler = re.compile(r"(?i)\b(ads?|advert\w*|banner|side-?bar|menu|nav|cookies?|notice|promo|related|share|social|breadcrumbs?|newsletter|comments?|footer|copyright)\b")


def semantic_label(element: Element | None) -> bool:
    """Whether a block lies in an article or main element and in nothing named after boilerplate."""
    return bool(element) and element.main and not never(element) and not any(_boiler.search(e.partition(" ")[2]) for e in element.path())


def train(pages: DataFrame, sampled: int = TRAIN_PAGES, made: int = MADE_PAGES, epochs: int = 8, seed: int = 9) -> Tagger:
    """Train the labeller on ``sampled`` pages with an article or main element, picked by hash of their id, and ``made`` pages of their words.

    Of the table only pages of less than 40,000 characters teach, and of a page its
    first 60 blocks; both bound what the labeller is fitted on, not what it labels.
    """
    usable = needed(pages, page_id="long", html="string").where("page_id is not null and html rlike '(?i)<(article|main)[ >]' and length(html) < 40000")
    # ids are picked first, so that what meets for the pick is small
    picked = usable.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sampled).distinct()
    rows = usable.join(F.broadcast(picked), "page_id").groupBy("page_id").agg(F.min("html").alias("html")).collect()
    rows.sort(key=lambda r: r["page_id"])
    rng, sequences = np.random.default_rng(seed), []
    for row in rows:
        found = blocks(row["html"])
        sequences.append((vectors(found), [semantic_label(e) for e, _, _ in found]))
    words = sorted({w for row in rows for _, t, _ in blocks(row["html"]) for w in t.split()[:200]})[:20_000] or ["word"]
    for _ in range(made):
        page, marks = made_page(words, rng)
        found = blocks(page)
        if len(found) == len(marks):
            sequences.append((vectors(found), marks))
    sequences = [s for s in sequences if len(s[1])]
    steps = min(60, max(len(m) for _, m in sequences))
    x = np.zeros((steps, len(sequences), PATH + WORDS + MEASURES), np.float32)
    mask, tags = np.zeros((steps, len(sequences)), bool), np.zeros((steps, len(sequences)), np.int64)
    for k, (v, marks) in enumerate(sequences):
        n = min(steps, len(marks))
        x[:n, k], mask[:n, k], tags[:n, k] = v[:n], True, np.array(marks[:n], np.int64)
    labeller = Tagger(PATH + WORDS + MEASURES, 12, 2, seed=seed)
    labeller.fit(x, mask, tags, epochs=epochs, batch=32, rate=0.02)
    return labeller


def main_texts(labeller: Tagger, pages: list[str]) -> list[str]:
    """The main text of each page; pages of like length are labelled side by side."""
    found = [blocks(p) for p in pages]
    forms = [page_forms(page) for page in found]
    flat = vectors([b for page in found for b in page], [f for page, f in zip(found, forms, strict=True) for _ in page])
    ends = np.concatenate([[0], np.cumsum([len(b) for b in found])])
    out = [""] * len(pages)
    order = sorted((k for k in range(len(pages)) if found[k]), key=lambda k: len(found[k]))
    at = 0
    while at < len(order):
        width, stop = len(found[order[at]]), at + 1
        while stop < len(order) and (stop - at) * len(found[order[stop]]) < 20_000 and len(found[order[stop]]) <= 1.3 * width + 4:
            stop += 1
        group = order[at:stop]
        steps = len(found[group[-1]])
        x, mask = np.zeros((steps, len(group), flat.shape[1]), np.float32), np.zeros((steps, len(group)), bool)
        for k, page in enumerate(group):
            n = len(found[page])
            x[:n, k], mask[:n, k] = flat[ends[page] : ends[page + 1]], True
        path = labeller.decode(x, mask)
        for k, page in enumerate(group):
            out[page] = "\n".join(t for (e, t, _), tag in zip(found[page], path[:, k], strict=False) if tag and not never(e, forms[page]))
        at = stop
    return out


def extract(pages: DataFrame, labeller: Tagger | None = None) -> DataFrame:
    """Per row of ``pages``: page_id, url, text (empty if there is none) and n_chars.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined in page order by a line feed. A null or empty page has
    an empty text; repeated rows each get theirs. Long, deep and broken pages are
    read whole, in time and memory proportional to them: what no > ends is text, an
    element that isn't closed ends with the page.
    """
    labeller = labeller or train(pages)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = main_texts(labeller, [p or "" for p in part.column("html").to_pylist()])
                yield from as_batches([{"page_id": part.column("page_id"), "url": part.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}], schema)

    return map_arrow(needed(pages, page_id="long", url="string", html="string"), run, "page_id long, url string, text string, n_chars long")
