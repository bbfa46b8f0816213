"""JSON in the texts that models give back: fenced, chatty, cut off. Rows are mended in attempts, and what can't be is kept apart."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.sources.samples import HEAD_FIELDS, RELATION_FIELDS, TAIL_FIELDS, first_text

_closers = {"{": "}", "[": "]"}


def mended(text: str) -> str | None:
    """The JSON value that a text begins, closed where it breaks off; null if it begins none.

    What stands before the first bracket and after the value's end goes. Trailing
    commas go, an open text is closed, and from the end as much is cut as keeps a
    value from being read: a key without its value, half a number or word.
    """
    begin = re.search(r"[{\[]", text)
    if not begin:
        return None
    text = text[begin.start() :]
    open_, inside, slash, out, stops = [], False, False, [], []
    for c in text:
        if inside:
            out.append(c if c >= " " else json.dumps(c)[1:-1])
            if slash:
                slash = False
            elif c == "\\":
                slash = True
            elif c == '"':
                inside = False
            continue
        if c in "}]":
            if not open_ or _closers[open_[-1]] != c:
                break
            while out and (out[-1].isspace() or out[-1] == ","):
                out.pop()
            open_.pop()
            out.append(c)
            if not open_:
                return "".join(out)
            continue
        if c == ",":
            stops.append((len(out), len(open_)))
        elif c in "{[":
            open_.append(c)
            stops.append((len(out) + 1, len(open_)))
        elif c == '"':
            inside = True
        out.append(c)
    if inside:
        if slash:
            out.pop()
        elif (cut := re.search(r"\\u[0-9a-fA-F]{0,3}\Z", "".join(out[-5:]))) is not None:
            del out[len(out) - len(cut[0]) :]
        out.append('"')
    closed = lambda n, depth: "".join(out[:n]).rstrip().rstrip(",") + "".join(_closers[b] for b in reversed(open_[:depth]))
    # the longest part that is JSON once closed: as it is, then up to the last commas and brackets
    depth = len(open_)
    for n, level in [(len(out), depth), *[s for s in reversed(stops) if s[1] <= depth][:3]]:
        try:
            found = closed(n, level)
            json.loads(found)
            return found
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def mend(texts: pd.Series) -> pd.Series:
    """``mended`` for a column; null for null."""
    return texts.map(lambda t: mended(t) if t is not None else None)


def unfenced(c: Column) -> Column:
    """What stands inside the first code fence, else the text."""
    inner = F.regexp_extract(c, r"(?s)```[a-zA-Z]*\s*(.*?)\s*```", 1)
    return F.when(inner != "", inner).otherwise(c)


def read_responses(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose text gives JSON, and a dead-letter table of the others.

    The first has ``parsed`` (variant) and ``attempts``: 1 as it stands, 2 out of its
    code fence, 3 mended. The second has ``attempts`` (3) and ``why``. A text that is
    null or blank is a dead letter. Every row is in one of the two; both have the
    other columns as they were.
    """
    text = F.coalesce(F.col(column), F.lit(""))
    own = F.try_parse_json(F.nullif(F.trim(text), F.lit("")))
    fenced = F.try_parse_json(F.nullif(F.trim(unfenced(text)), F.lit("")))
    tried = df.withColumns({"_own": own, "_fenced": fenced})
    tried = tried.withColumn("_mended", F.try_parse_json(mend(F.when(F.col("_own").isNull() & F.col("_fenced").isNull(), unfenced(text)))))
    tried = tried.withColumn("attempts", F.when(F.col("_own").isNotNull(), 1).when(F.col("_fenced").isNotNull(), 2).otherwise(3)).withColumn("parsed", F.coalesce("_own", "_fenced", "_mended"))
    good = tried.where("parsed IS NOT NULL").select(*df.columns, "parsed", "attempts")
    why = F.when(F.trim(text) == "", "blank").when(~text.rlike(r"[{\[]"), "no bracket").otherwise("broken")
    return good, tried.where("parsed IS NULL").select(*df.columns, "attempts", why.alias("why"))


def triples_of(parsed: DataFrame, key: list[str]) -> DataFrame:
    """key, place, subject, predicate and object of the triples that parsed responses list.

    A response is a list, or an object with ``triples`` or ``fact``; an entry is a list of
    three texts or an object under any of the names of heads, relations and tails.
    Entries with an empty or missing part, and those said before in the response, go.
    """
    v = F.col("parsed")
    listed = F.coalesce(*[F.try_variant_get(v, p, "array<variant>") for p in ("$", "$.triples", "$.fact")])
    each = parsed.select(*key, F.posexplode(listed).alias("place", "e"))
    e = F.col("e")
    part = lambda i, names: F.trim(F.coalesce(F.try_variant_get(e, f"$[{i}]", "string"), first_text(e, names), F.lit("")))
    flat = each.select(*key, "place", part(0, HEAD_FIELDS).alias("subject"), part(1, RELATION_FIELDS).alias("predicate"), part(2, TAIL_FIELDS).alias("object"))
    whole = flat.where("subject != '' AND predicate != '' AND object != ''")
    return whole.groupBy(*key, "subject", "predicate", "object").agg(F.min("place").alias("place")).select(*key, "place", "subject", "predicate", "object")
