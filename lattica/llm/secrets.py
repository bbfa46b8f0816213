"""Secret scans: base patterns, and multipart credential linking by an interval join; DataFrame expressions only.

Base matches (assignments, access ids, long hex) are reported as they are. Weak
candidates, which alone are too common to report, are long mixed tokens (secrets)
and assigned account names (identifiers). With base matches and endpoints (URLs
and assigned hosts) they form the parts of a text. Weak parts are dealt into the
buckets of REACH code points that they cover, and joined with the parts that
cover a bucket of their text when widened by REACH on both sides; parts within
REACH of each other share a bucket, however long they are. A weak secret is
reported when an identifier or an endpoint lies in its scope (a paragraph) within
REACH, a weak identifier when a secret does. A secret inside an endpoint, as a value
of its query or the password of its address, has the endpoint as its partner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.columns import let, needed
from lattica.session import cut


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + f"|{_either_case('api')}_?{_either_case('key')}"
_IS = r"""["']?\x20*[:=]\x20*["']?"""
#: The base patterns and their kinds, in the order in which kinds are listed.
BASE = {
    "assign": f"(?:{_KEYS}){_IS}([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]{12,}",
    "hex": "(?<![0-9a-f])[0-9a-f]{32,}",
}
LEAST_VALUE = 8
#: Weak parts: kind, pattern, and a pattern that the match must hold as well.
IDENTIFIER = f"(?:{'|'.join(_either_case(w) for w in ('client', 'access', 'account', 'user', 'key'))})[_-]?(?:{_either_case('id')}|{_either_case('name')}){_IS}[A-Za-z0-9@._-]{{4,}}"
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\x20\x09-\x0D"'<>]+|(?:[Hh]ost|[Ss]erver|[Ee]ndpoint)\x20*[:=]\x20*[^\x20\x09-\x0D]+"""
SECRET = "(?<![A-Za-z0-9/+=_-])[A-Za-z0-9/+_-]{20,64}(?![A-Za-z0-9/+=_-])"
#: Weak secrets inside an endpoint, whose partner it is: values of a query, and the password before an address.
IN_QUERY = r"[?&;][A-Za-z0-9_.-]{1,40}=[A-Za-z0-9/+_-]{20,64}(?![A-Za-z0-9/+=_-])"
IN_ADDRESS = r"""//[^\x20\x09-\x0D/@:"'<>]{1,64}:[^\x20\x09-\x0D/@"'<>]{8,64}@"""
REACH = 300
KINDS = (*BASE, "linked_id", "linked_secret")

#: Stand between matches and the rest; where a text holds them itself they are taken for OTHER, which no pattern matches.
CUT, OTHER = "\ue000", "\ue001"
_SPANS = "array<struct<kind:int,start:bigint,end:bigint>>"


def _matches(text: Column, pattern: str) -> Column:
    """(start, end, match) of the leftmost non-overlapping matches, in code points, end exclusive."""
    parts = F.split(F.regexp_replace(text, f"({pattern})", f"{CUT}$1{CUT}"), CUT)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,match:string>>").alias("out"), F.lit(False).alias("inside"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        found = F.struct(acc["at"].alias("start"), end.alias("end"), part.alias("match"))
        return F.struct(end.alias("at"), F.when(acc["inside"], F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"), (~acc["inside"]).alias("inside"))

    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    return F.when(text.rlike(pattern), F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(none)


def _as_kind(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))).cast(_SPANS)


def _apart(spans: Column, base: Column) -> Column:
    return F.filter(spans, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, base and linked, arrays of (kind, start, end), each by start, then kind; kind counts in KINDS.

    The whole text is searched; a null text has no spans. Matches that fail a
    length rule are dropped without another try. Linked spans don't touch base
    spans. Repeated rows each get theirs.
    """
    df = needed(docs, doc_id="long", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("text", F.when(F.contains("text", F.lit(CUT)), F.translate("text", CUT, OTHER)).otherwise(F.col("text")))
    assign = F.filter(_matches(F.col("text"), BASE["assign"]), lambda m: F.length(F.regexp_extract(m["match"], BASE["assign"], 1)) >= LEAST_VALUE)
    base = F.concat(_as_kind(assign, 0), *[_as_kind(_matches(F.col("text"), BASE[k]), i) for i, k in enumerate(BASE) if i])
    df = df.withColumn("base", base)
    df = df.withColumn("ids", _apart(_as_kind(_matches(F.col("text"), IDENTIFIER), 3), F.col("base")))
    df = df.withColumn("ends", _as_kind(_matches(F.col("text"), ENDPOINT), 5))
    # a weak secret needs an identifier or an endpoint, so texts without any are not searched for it
    partner = (F.size("ids") > 0) | (F.size("ends") > 0) | F.exists("base", lambda b: b["kind"] == 1)
    mixed = F.filter(_matches(F.col("text"), SECRET), lambda m: m["match"].rlike("[0-9]") & m["match"].rlike("[A-Za-z]"))
    none = F.array().cast(_SPANS)
    df = df.withColumn("weak", F.when(partner, _apart(_as_kind(mixed, 4), F.concat("base", "ids", "ends"))).otherwise(none))
    # what lies in an endpoint: the value behind the last = of a parameter, and what stands between : and @
    value = lambda m, size, before: F.struct((m["end"] - size - before).alias("start"), (m["end"] - before).alias("end"), m["match"].alias("match"))
    told = F.transform(_matches(F.col("text"), IN_QUERY), lambda m: value(m, F.length(F.regexp_extract(m["match"], "=([^=]+)$", 1)), 0))
    told = F.filter(told, lambda m: m["match"].rlike("=(?=[^=]*[0-9])(?=[^=]*[A-Za-z])[^=]*$"))
    passwords = F.transform(_matches(F.col("text"), IN_ADDRESS), lambda m: value(m, F.length(F.regexp_extract(m["match"], "^//[^:]*:(.*)@$", 1)), 1))
    inner = _apart(_as_kind(F.concat(told, passwords), 4), F.concat("base", "ids"))
    df = df.withColumn("weak", F.concat("weak", F.when(F.contains("text", F.lit("://")), inner).otherwise(none)))
    # the paragraph of each part, from where paragraphs begin
    parts = F.when((F.size("weak") > 0) | (F.size("ids") > 0), F.concat("base", "ids", "ends", "weak")).otherwise(F.array().cast(_SPANS))
    breaks = F.transform(_matches(F.col("text"), r"\n[\x20\t]*\n"), lambda m: m["start"])
    placed = let(breaks, lambda b: F.transform(parts, lambda p: F.struct(*[p[c].alias(c) for c in ("kind", "start", "end")], F.size(F.filter(b, lambda x: x < p["start"])).alias("scope"))))
    keyed = cut(df.select("doc_id", "base", F.when(F.size(parts) > 0, placed).alias("parts"), F.monotonically_increasing_id().alias("row_key")))

    each = keyed.select("row_key", F.explode("parts").alias("p")).select("row_key", "p.*")
    buckets = lambda start, end: F.explode(F.sequence(F.floor(start / REACH), F.floor(end / REACH))).alias("bucket")
    weak = each.where(F.col("kind").isin(3, 4)).select("row_key", "kind", "start", "end", "scope", buckets(F.col("start"), F.col("end")))
    others = each.select("row_key", "scope", F.col("kind").alias("o_kind"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), buckets(F.col("start") - REACH, F.col("end") + REACH))
    gap = F.greatest(F.col("start") - F.col("o_end"), F.col("o_start") - F.col("end"))
    complement = F.when(F.col("kind") == 4, F.col("o_kind").isin(1, 3, 5)).otherwise(F.col("o_kind").isin(0, 2, 4))
    linked = weak.join(others, ["row_key", "bucket", "scope"]).where((gap <= REACH) & complement).select("row_key", "kind", "start", "end").distinct()
    by_row = linked.groupBy("row_key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))
    in_order = lambda spans: F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    out = keyed.drop("parts").join(by_row, "row_key", "left")
    return out.select("doc_id", in_order(F.col("base")).alias("base"), in_order(F.coalesce("linked", F.array().cast(_SPANS))).alias("linked"))


def digest(found: DataFrame) -> DataFrame:
    """n_assign, n_access, n_hex and base_sha256 of the base spans; spans has all of them."""
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    every = F.transform(F.array_sort(F.transform(F.concat("base", "linked"), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == F.lit(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"))
