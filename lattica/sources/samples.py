"""Samples of question-answering data sets, whose fields differ from set to set, as uniform tables.

A sample is one JSON text. Its variants are told apart by shape, so the readers
work on Spark's variant type: nothing has to agree over a file, and a sample that
can't be parsed is an error unless it is asked to be left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import let

#: Names under which samples keep their id, question, answer, and contexts their title, sentences and triples.
ID_FIELDS = ("id", "_id", "sample_id")
QUESTION_FIELDS = ("question", "Q", "query")
ANSWER_FIELDS = ("answer", "A", "answers")
TITLE_FIELDS = ("title", "Title")
TEXT_FIELDS = ("sentences", "paragraph_text", "text", "content")
HEAD_FIELDS = ("name", "head", "Head", "subject")
RELATION_FIELDS = ("description_type", "relation", "Relation", "predicate")
TAIL_FIELDS = ("description", "tail", "Tail", "object")


def _get(v: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def first_text(v: Column, names: tuple[str, ...]) -> Column:
    """The first of some fields that is a text that isn't blank; a list gives its first text, a number its digits."""
    plain = lambda n: F.when(F.schema_of_variant(_get(v, n, "variant")).startswith("ARRAY"), F.try_variant_get(v, f"$.{n}[0]", "string")).otherwise(_get(v, n, "string"))
    return F.coalesce(*[F.nullif(F.trim(plain(n)), F.lit("")) for n in names])


def as_sentences(v: Column) -> Column:
    """Sentences of a field that is a list of texts or one text: trimmed, without empty ones."""
    listed = F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array(F.try_variant_get(v, "$", "string")))
    return F.filter(F.transform(listed, lambda x: F.trim(x)), lambda s: s.isNotNull() & (s != ""))


def safe_int(c: Column | str) -> Column:
    """The number of a text of digits alone, else null."""
    text = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def titled_text(title: Column | str, body: Column | str) -> Column:
    """``Title: x``, a line break and the body; the body alone where there is no title."""
    t, b = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (title, body))
    return F.when(F.trim(t) == "", F.trim(b)).otherwise(F.concat(F.lit("Title: "), F.trim(t), F.lit("\n"), F.trim(b)))


def title_of_text(c: Column | str) -> Column:
    """The title that ``titled_text`` wrote; empty if there is none."""
    return F.regexp_extract(c, r"^Title: ([^\n]*)\n", 1)


def parse(raw: DataFrame, column: str = "json", skip_malformed: bool = False) -> DataFrame:
    """Add ``sample`` (variant) and ``sample_id`` (id, else the row's ``source_index``); malformed text is an error, or left out."""
    df = raw.withColumn("sample", (F.try_parse_json if skip_malformed else F.parse_json)(F.col(column)))
    df = df.where(F.col("sample").isNotNull()) if skip_malformed else df
    return df.withColumn("sample_id", F.coalesce(first_text(F.col("sample"), ID_FIELDS), F.col("source_index").cast("string")))


def questions(samples: DataFrame) -> DataFrame:
    """sample_id, source_index, question and answer; a field that is missing is an empty text."""
    s = F.col("sample")
    return samples.select("sample_id", "source_index", F.coalesce(first_text(s, QUESTION_FIELDS), F.lit("")).alias("question"), F.coalesce(first_text(s, ANSWER_FIELDS), F.lit("")).alias("answer"))


def _elements(v: Column) -> Column:
    """Elements of a variant that is a list; a single object or text is a list of itself; null has none."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(v.isNotNull() & (F.schema_of_variant(v) != "VOID"), F.array(v)), F.array().cast("array<variant>"))


def contexts(samples: DataFrame) -> DataFrame:
    """sample_id, source_index, ord, title, sentences, supporting and item: the contexts of each sample in order.

    A context is a text, an object with title and sentences (or text), or a pair of
    title and sentences; ``paragraphs`` come after ``context``. Those without any text
    are left out; their places stay counted.
    """
    s = F.col("sample")
    every = F.concat(_elements(_get(s, "context", "variant")), _elements(_get(s, "paragraphs", "variant")))
    each = samples.select("sample_id", "source_index", F.col("sample"), F.posexplode(every).alias("ord", "item"))
    item, shape = F.col("item"), F.schema_of_variant(F.col("item"))
    is_pair = shape.startswith("ARRAY")
    own_title = F.coalesce(first_text(item, TITLE_FIELDS), F.lit(""))
    body = F.coalesce(*[_get(item, n, "variant") for n in TEXT_FIELDS])
    title = F.when(is_pair, F.trim(F.try_variant_get(item, "$[0]", "string"))).when(shape == "STRING", F.coalesce(first_text(F.col("sample"), TITLE_FIELDS), F.lit(""))).otherwise(own_title)
    sentences = F.when(is_pair, as_sentences(F.try_variant_get(item, "$[1]", "variant"))).when(shape == "STRING", as_sentences(item)).otherwise(as_sentences(body))
    supporting = F.coalesce(_get(item, "is_supporting", "boolean"), F.lit(False))
    out = each.select("sample_id", "source_index", "ord", F.coalesce(title, F.lit("")).alias("title"), F.coalesce(sentences, F.array().cast("array<string>")).alias("sentences"), F.when(is_pair | (shape == "STRING"), F.lit(False)).otherwise(supporting).alias("supporting"), "item")
    return out.where(F.size("sentences") > 0)


def _triple(v: Column) -> Column:
    """Type, subject, predicate and object of a triple under any of its names; a triple without a type is a relation."""
    text = lambda names: F.coalesce(first_text(v, names), F.lit(""))
    kind = F.upper(F.coalesce(first_text(v, ("type", "triple_type")), F.lit("RELATION")))
    return F.struct(kind.alias("triple_type"), text(HEAD_FIELDS).alias("subject"), text(RELATION_FIELDS).alias("predicate"), text(TAIL_FIELDS).alias("object"), first_text(v, TITLE_FIELDS).alias("title"))


def triples(samples: DataFrame, dataset_id: str, context_first: bool = False) -> DataFrame:
    """Raw triples of samples in the columns that a store is built from.

    A sample's own ``triple_list`` wins over those of its contexts, or with
    ``context_first`` the other way; triple_index counts over the list taken.
    Triples of a context have its title unless they name one.
    """
    s = F.col("sample")
    held = lambda v: F.coalesce(F.try_variant_get(v, "$.triple_list", "array<variant>"), F.try_variant_get(v, "$.triples", "array<variant>"), F.array().cast("array<variant>"))
    every = F.concat(_elements(_get(s, "context", "variant")), _elements(_get(s, "paragraphs", "variant")))
    entry = lambda v, title: F.struct(_triple(v).alias("t"), title.alias("of"))
    own = F.transform(held(s), lambda v: entry(v, F.lit("")))
    inner = F.flatten(F.transform(every, lambda c: let(F.coalesce(first_text(c, TITLE_FIELDS), F.lit("")), lambda title: F.transform(held(c), lambda v: entry(v, title)))))
    a, b = (inner, own) if context_first else (own, inner)
    each = samples.select("sample_id", "source_index", F.posexplode(F.when(F.size(a) > 0, a).otherwise(b)).alias("triple_index", "e"))
    return each.select(F.lit(dataset_id).alias("dataset_id"), "sample_id", F.col("source_index").cast("long").alias("source_index"), "triple_index", "e.t.triple_type", "e.t.subject", "e.t.predicate", "e.t.object", F.coalesce("e.t.title", "e.of").alias("title"))


def hops(samples: DataFrame) -> DataFrame:
    """sample_id, hops and bucket: how many steps a question takes.

    The number of its evidences, else of steps of its decomposition, else the digit
    before ``hop`` in its id, else of distinct titles of its supporting facts, else
    of its supporting contexts; null where none tells. From four on, one bucket.
    """
    s = F.col("sample")
    n = lambda name: F.nullif(F.size(F.try_variant_get(s, f"$.{name}", "array<variant>")), F.lit(0))
    by_id = F.nullif(F.regexp_extract("sample_id", "^([0-9]+)hop", 1), F.lit("")).cast("int")
    titles = F.nullif(F.size(F.array_distinct(F.transform(F.try_variant_get(s, "$.supporting_facts", "array<variant>"), lambda v: F.coalesce(F.try_variant_get(v, "$[0]", "string"), F.try_variant_get(v, "$", "string"))))), F.lit(0))
    supported = F.nullif(F.size(F.filter(F.coalesce(F.try_variant_get(s, "$.paragraphs", "array<variant>"), F.array().cast("array<variant>")), lambda v: F.coalesce(F.try_variant_get(v, "$.is_supporting", "boolean"), F.lit(False)))), F.lit(0))
    found = F.coalesce(n("evidences"), n("question_decomposition"), by_id, F.when(titles > 0, titles), supported)
    return samples.select("sample_id", found.alias("hops")).withColumn("bucket", F.when(F.col("hops").isNull(), "unknown").when(F.col("hops") >= 4, "4+").otherwise(F.col("hops").cast("string")))


def supporting_titles(samples: DataFrame) -> DataFrame:
    """sample_id and title of supporting facts; of supporting contexts where a sample lists no facts."""
    s = F.col("sample")
    facts = F.transform(F.coalesce(F.try_variant_get(s, "$.supporting_facts", "array<variant>"), F.array().cast("array<variant>")), lambda v: F.coalesce(F.try_variant_get(v, "$[0]", "string"), F.try_variant_get(v, "$", "string")))
    marked = F.transform(F.filter(F.coalesce(F.try_variant_get(s, "$.paragraphs", "array<variant>"), F.array().cast("array<variant>")), lambda v: F.coalesce(F.try_variant_get(v, "$.is_supporting", "boolean"), F.lit(False))), lambda v: F.try_variant_get(v, "$.title", "string"))
    return samples.select("sample_id", F.explode(F.array_distinct(F.when(F.size(facts) > 0, facts).otherwise(marked))).alias("title")).where("title is not null")


def oracle_contexts(ctx: DataFrame, titles: DataFrame, indexes: DataFrame) -> DataFrame:
    """sample_id, place and text: contexts a sample's answer rests on, by index, then by title, then by their own mark; each text once.

    ``ctx`` is the result of ``contexts``; ``titles`` has sample_id and title, ``indexes`` sample_id and ord.
    """
    text = ctx.select("sample_id", "ord", "title", "supporting", F.array_join("sentences", " ").alias("text"))
    by_index = text.join(indexes.select("sample_id", "ord").distinct(), ["sample_id", "ord"], "left_semi").withColumn("prio", F.lit(0))
    by_title = text.join(titles.select("sample_id", "title").distinct(), ["sample_id", "title"], "left_semi").withColumn("prio", F.lit(1)).select(*text.columns, "prio")
    by_mark = text.where("supporting").withColumn("prio", F.lit(2))
    first = by_index.select(*text.columns, "prio").unionByName(by_title).unionByName(by_mark).groupBy("sample_id", "text").agg(F.min(F.struct("prio", "ord")).alias("at"))
    listed = first.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("all"))
    return listed.select("sample_id", F.posexplode("all.text").alias("place", "text"))

