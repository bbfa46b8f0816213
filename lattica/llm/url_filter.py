"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest; DataFrame expressions and Spark's own trees only."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.columns import let, needed
from lattica.session import cut

#: Fixed values: (verdict, host suffix, path prefix).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Bound of the labelled rows that the trees are fitted on, picked by hash of the url.
LABELLED = 20_000
FEATURES = ("length", "host_length", "path_length", "depth", "host_parts", "digit_ratio", "host_digits", "hyphens", "entropy", "parameters", "suffix_share", "suffix_length", "has_page", "secure", "longest_part")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or the end; empty where there is no ://."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (host and path as one string) that fits, and its verdict; null where none does. Of equally long ones the first wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits per character of a text; 0 for an empty one. Equal characters stand together once sorted, so each is counted in one pass."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    weight = lambda n: F.when(n > 0, n * F.log2(n)).otherwise(0.0)
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.lit(0.0).alias("total"))
    step = lambda s, c: F.when(c == s["last"], F.struct(s["last"].alias("last"), (s["n"] + 1).alias("n"), s["total"].alias("total"))).otherwise(F.struct(c.alias("last"), F.lit(1).alias("n"), (s["total"] + weight(s["n"])).alias("total")))
    return F.coalesce(F.log2(F.length(text)) - F.aggregate(chars, start, step, lambda s: s["total"] + weight(s["n"])) / F.length(text), F.lit(0.0))


def lexical(urls: DataFrame) -> DataFrame:
    """Add host, path and the lexical features, but for the suffix statistics, to a table with a url column."""
    host, path = host_and_path(F.col("url"))
    df = urls.withColumn("host", host).withColumn("path", path)
    url = F.coalesce("url", F.lit(""))
    count = lambda text, pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    parts = F.split("host", r"\.")
    size = F.length(url)
    return df.withColumns(
        {
            "suffix": F.element_at(parts, -1),
            "length": size.cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": count(F.col("path"), "/").cast("double"),
            "host_parts": F.size(parts).cast("double"),
            "digit_ratio": count(url, "[0-9]") / F.greatest(size, F.lit(1)),
            "host_digits": count(F.col("host"), "[0-9]").cast("double"),
            "hyphens": count(F.col("host"), "-").cast("double"),
            "entropy": _entropy(F.col("host")),
            "parameters": F.when(F.contains(url, F.lit("?")), count(url, "&") + 1).otherwise(0).cast("double"),
            "suffix_length": F.length(F.element_at(parts, -1)).cast("double"),
            "has_page": url.rlike(r"\.[a-z]{2,5}($|[?#])").cast("double"),
            "secure": url.startswith("https:").cast("double"),
            "longest_part": F.array_max(F.transform(parts, lambda p: F.length(p))).cast("double"),
        }
    )


class UrlClassifier:
    """Boosted trees over lexical features, with the block share of each suffix (a bounded table)."""

    def __init__(self, model: GBTClassificationModel | None, suffixes: DataFrame, base: float):
        self.model, self.suffixes, self.base = model, suffixes, base

    def score(self, featured: DataFrame) -> DataFrame:
        """Add block_score, 0 to 1, to a table with lexical features."""
        df = featured.join(F.broadcast(self.suffixes), "suffix", "left").withColumn("suffix_share", F.coalesce("suffix_share", F.lit(self.base)))
        if self.model is None:
            return df.withColumn("block_score", F.lit(self.base))
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(df)
        return self.model.transform(vectors).withColumn("block_score", vector_to_array("_probability")[1]).drop("_features", "_raw", "_probability", "_prediction")


def train(labelled: DataFrame, rows: int = LABELLED, trees: int = 8, depth: int = 3) -> UrlClassifier:
    """Fit on at most ``rows`` labelled urls (url, blocked as 0 or 1), picked by hash; null labels teach nothing.

    Suffix statistics are the smoothed block shares of the commonest suffixes of
    the sample, 500 at most; a row is trained with the share of the others. Labels of one kind only leave no trees: every score
    is then the share of blocked labels.
    """
    sample = needed(labelled, url="string", blocked="int").where("url is not null and blocked is not null").orderBy(F.xxhash64("url"), "url", "blocked").limit(rows)
    featured = lexical(sample).withColumn("label", F.col("blocked").cast("double")).cache()
    n, blocked = featured.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    base = (blocked + 1) / (n + 2)
    shares = featured.groupBy("suffix").agg(F.count("*").alias("_n"), F.sum("label").alias("_b")).orderBy(F.desc("_n"), "suffix").limit(500)
    counts = cut(shares)
    smoothed = lambda b, n: (b + 10 * base) / (n + 10)
    suffixes = counts.select("suffix", smoothed(F.col("_b"), F.col("_n")).alias("suffix_share"))
    found = UrlClassifier(None, suffixes, base)
    if 0 < blocked < n:
        # a row's own label stays out of its suffix's share
        others = F.coalesce(smoothed(F.col("_b") - F.col("label"), F.col("_n") - 1), F.lit(base))
        own = featured.join(F.broadcast(counts), "suffix", "left").withColumn("suffix_share", others)
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(own)
        boosted = GBTClassifier(featuresCol="_features", labelCol="label", predictionCol="_prediction", maxIter=trees, maxDepth=depth, maxBins=32, seed=5)
        boosted.setProbabilityCol("_probability").setRawPredictionCol("_raw")
        found.model = boosted.fit(vectors.select("_features", "label"))
    featured.unpersist()
    return found


def rule_labels(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Labelled urls: those that a rule decides, blocked 1 or 0."""
    host, path = host_and_path(F.col("url"))
    _, verdict = matching_rule(host, path, rules)
    return needed(pages, url="string").select("url", (verdict == "block").cast("int").alias("blocked")).where("blocked is not null")


def judge(pages: DataFrame, classifier: UrlClassifier, rules: list[tuple[str, str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict and block_score.

    A null url, or one without ://, has empty host and path, fits no rule and is
    judged by its features. Repeated rows get equal verdicts.
    """
    scored = classifier.score(lexical(needed(pages, page_id="long", url="string")))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "block_score")
