"""Quality rules by distribution divergence, as DataFrame expressions only.

Each text gets two histograms: of character classes, and of the common words of
its language among its words. The language's reference is the sum of the
histograms over all its texts that pass the base rules. A text is turned down
when the Jensen-Shannon distance of one of its histograms from the reference is
above a threshold; texts too short for a stable histogram are not judged by it,
nor are texts in a language without a word list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.columns import let, needed
from lattica.session import cut

#: Common words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on"],
    "de": ["der", "die", "und", "das", "in", "zu", "den", "ist", "von", "mit", "nicht", "im"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
}
#: Guards and thresholds: characters and words a histogram needs, and the largest distances (square roots of divergences in bits).
MIN_CHARS, MIN_WORDS, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 400, 100, 0.32, 0.29
#: Character classes, in the order in which they are taken out of the text.
CHAR_CLASSES = {"lower": "[a-z]+", "upper": "[A-Z]+", "digit": "[0-9]+", "space": r"[\x20\x09-\x0D]+", "symbol": "[#*$%&|<>]+", "punctuation": r"[\x00-\x7F]+"}
SPACE = r"\x20\x09-\x0D"
RUN = 8


def _repeat_words(words: Column) -> Column:
    """Words that lie in a run of RUN words found twice or more in the list."""

    def counted(grams: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            repeated = F.filter(s, lambda e, k: (F.get(s, k - 1)["x"] == e["x"]) | (F.get(s, k + 1)["x"] == e["x"]))
            return let(
                F.sort_array(F.transform(repeated, lambda e: e["i"])),
                lambda at: F.aggregate(F.transform(at, lambda i, k: F.least(F.lit(RUN), F.coalesce(F.get(at, k + 1) - i, F.lit(RUN)))), F.lit(0), lambda x, y: x + y),
            )

        ordered = F.array_sort(F.transform(grams, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) < F.size(grams), let(ordered, of_sorted)).otherwise(F.lit(0))

    def of_hashes(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - RUN)
        return let(F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(RUN)])), counted)

    return F.when(F.size(words) > RUN, let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)).otherwise(F.lit(0)).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, lang, the base measures, base_failed and the two histograms chars and words."""
    text = F.coalesce("text", F.lit(""))
    df = needed(docs, doc_id="long", text="string", lang="string").select("doc_id", "lang", text.alias("text"))
    df = df.withColumn("w", F.regexp_extract_all("text", F.lit(f"[^{SPACE}]+"), F.lit(0)))
    # what is left of the text after each class is taken out
    left, chars = F.col("text"), []
    for name, pattern in CHAR_CLASSES.items():
        df = df.withColumn(f"without_{name}", F.regexp_replace(left, pattern, ""))
        chars.append((F.length(left) - F.length(f"without_{name}")).cast("long"))
        left = F.col(f"without_{name}")
    chars.append(F.length(left).cast("long"))
    lists = F.create_map(*[x for lang, words in COMMON_WORDS.items() for x in (F.lit(lang), F.array(*[F.lit(v) for w in words for v in (w, w.capitalize())]))])
    df = df.withColumn("list", F.try_element_at(lists, F.coalesce("lang", F.lit(""))))
    df = df.withColumn("hits", F.filter("w", lambda w: F.array_contains("list", w)))
    lower = lambda k: F.size(F.filter("hits", lambda w: (w == F.get("list", F.lit(2 * k))) | (w == F.get("list", F.lit(2 * k + 1))))).cast("long")
    k = len(next(iter(COMMON_WORDS.values())))
    common = [lower(i) for i in range(k)]
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    out = df.select(
        "doc_id",
        "lang",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.array(*chars).alias("chars"),
        F.array(*common).alias("words"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("w")).alias("n_repeat_words"),
    )
    symbols = F.col("chars")[list(CHAR_CLASSES).index("symbol")]
    rest = F.col("n_words") - F.aggregate("words", F.lit(0).cast("long"), lambda x, y: x + y)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("n_symbols", symbols).withColumn("words", F.concat("words", F.array(rest))).withColumn("base_failed", failed)


def references(measured: DataFrame) -> DataFrame:
    """The summed histograms of each listed language (a few rows), over all its texts that pass the base rules."""
    good = measured.where(F.col("lang").isin(*COMMON_WORDS) & ~F.col("base_failed"))
    sums = lambda name, n: F.array(*[F.sum(F.col(name)[i]) for i in range(n)]).alias(f"ref_{name}")
    return good.groupBy("lang").agg(sums("chars", len(CHAR_CLASSES) + 1), sums("words", len(next(iter(COMMON_WORDS.values()))) + 1))


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance (square root of the divergence in bits) of two arrays of counts; null if one has none."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y)

    def term(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def summed(n: Column) -> Column:
        parts = F.zip_with(a, b, lambda x, y: F.struct((x / n["a"]).alias("p"), (y / n["b"]).alias("q")))
        each = F.transform(parts, lambda s: (term(s["p"], (s["p"] + s["q"]) / 2) + term(s["q"], (s["p"] + s["q"]) / 2)) / 2)
        return F.sqrt(F.greatest(F.aggregate(each, F.lit(0.0), lambda x, y: x + y), F.lit(0.0)))

    return let(F.struct(F.nullif(total(a), F.lit(0).cast("long")).alias("a"), F.nullif(total(b), F.lit(0).cast("long")).alias("b")), lambda n: F.when(n["a"].isNotNull() & n["b"].isNotNull(), summed(n)))


def judge(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    and the distances char_distance and word_distance (null where a guard leaves the text unjudged).

    A null text has no words and fails the base rules. A null or unlisted language
    is judged by the base rules only. Repeated rows count each and get equal results.
    """
    measured = cut(measures(docs))
    joined = measured.join(F.broadcast(references(measured)), "lang", "left")
    char = F.when(F.aggregate("chars", F.lit(0).cast("long"), lambda x, y: x + y) >= MIN_CHARS, js_distance(F.col("chars"), F.col("ref_chars")))
    word = F.when(F.col("n_words") >= MIN_WORDS, js_distance(F.col("words"), F.col("ref_words")))
    out = joined.withColumn("char_distance", char).withColumn("word_distance", word)
    near = (F.coalesce("char_distance", F.lit(0.0)) <= MAX_CHAR_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & near).alias("kept"), "char_distance", "word_distance")
