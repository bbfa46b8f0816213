"""Toxicity by non-negative positive-unlabelled learning.

A text's features are hashes of its words and of their beginnings, taken once
each. From the training rows come confirmed toxic texts (P) and, whatever their
labels say, unlabelled ones (U). Features are ranked by how much oftener they
occur in P than in U; on the best ones a linear classifier is trained in numpy by
the non-negative risk

    prior * R(P, toxic) + max(0, R(U, clean) - prior * R(P, clean))

(logistic loss), in which the second part corrects U for the toxic texts in it
by the class prior. Where the corrected risk of a batch falls below zero, the
step goes the other way, which keeps the classifier from fitting U by heart.

The sample that the classifier is fitted on is bounded (``positives``,
``unlabelled``) and picked by hash of the id; every text is scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.columns import needed
from lattica.llm.textscan import NOT_ALNUM, U64, Words, as_batches, map_arrow, mix, slices, text_bytes
from lattica.session import cut

BITS = 22
#: Bytes of text whose features are taken at a time; a byte of text comes to about 30 of features.
SLICE = 1 << 19
#: Bytes of word beginnings that are features, beside the whole word.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: Bounds of the sample and of the features of the classifier.
POSITIVES, UNLABELLED, FEATURES = 4000, 8000, 6000
#: A feature is used if of the texts with it an estimated share of this at least is toxic, and its log-likelihood gain over chance is this at least.
LEAST_SHARE, LEAST_GAIN = 0.55, 14.0


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature) of every word and word beginning of the texts; features are below 2**BITS and may repeat."""
    words = Words(*text_bytes(column), NOT_ALNUM)
    shift = U64(64 - BITS)
    docs, found = [words.doc], [words.range_hash(words.starts, words.ends) >> shift]
    size = words.ends - words.starts
    for n in BEGINNINGS:
        long = size > n
        docs.append(words.doc[long])
        start = words.starts[long]
        found.append(mix(words.range_hash(start, start + n) + U64(n)) >> shift)
    return np.concatenate(docs), np.concatenate(found).astype(np.int64)


@dataclass
class Classifier:
    """weights[f] for feature f, 0 for those left out; a text's score is the logistic of bias + sum over its distinct features."""

    weights: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        doc, feature = features(column)
        used = self.weights[feature] != 0
        pair = np.unique(doc[used] << BITS | feature[used])
        total = np.bincount(pair >> BITS, self.weights[pair & ((1 << BITS) - 1)], len(column))
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))


def choose_features(df_p: np.ndarray, df_u: np.ndarray, n_p: int, n_u: int, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """(gain, whether usable) of features by the numbers of P and U texts that hold them."""
    share_p, share_u = (df_p + 0.5) / (n_p + 1), (df_u + 0.5) / (n_u + 1)
    gain = df_p * np.log(share_p / share_u)
    return gain, (df_p >= 3) & (prior * share_p > LEAST_SHARE * share_u) & (gain > LEAST_GAIN)


def distinct_features(texts: pa.Array, among: np.ndarray | None = None) -> list[np.ndarray]:
    """The distinct features of each text, those of ``among`` (sorted) if given."""
    doc, feature = features(texts)
    if among is not None:
        known = np.isin(feature, among)
        doc, feature = doc[known], feature[known]
    pair = np.unique(doc << BITS | feature)
    return np.split(pair & ((1 << BITS) - 1), np.searchsorted(pair, np.arange(1, len(texts)) << BITS)) if len(texts) else []


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], chosen: np.ndarray, prior: float, epochs: int = 30, rate: float = 0.1, decay: float = 1e-4, seed: int = 3) -> Classifier:
    """Fit the classifier on the ``chosen`` features of the texts of P and U; ``prior`` is the share of toxic texts in U."""
    weights = np.zeros(1 << BITS, np.float32)
    if not positive or not unlabelled:
        return Classifier(weights, -10.0)
    if not len(chosen):
        return Classifier(weights, float(np.log(prior / (1 - prior))))
    column = np.full(1 << BITS, -1, np.int64)
    column[chosen] = np.arange(len(chosen))

    def packed(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        kept = [c[c >= 0] for c in (column[r] for r in rows)]
        return np.concatenate(kept), np.concatenate([[0], np.cumsum([len(k) for k in kept])])

    p, u = packed(positive), packed(unlabelled)
    w, bias = np.zeros(len(chosen)), float(np.log(prior / (1 - prior)))
    m, v, k = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), 0
    rng = np.random.default_rng(seed)

    def take(side: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values, offsets = side
        n = offsets[rows + 1] - offsets[rows]
        ends = np.cumsum(n)
        return values[np.repeat(offsets[rows] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], np.repeat(np.arange(len(rows)), n)

    size_u = 512
    for _ in range(epochs):
        order = rng.permutation(len(unlabelled))
        for at in range(0, len(order), size_u):
            rows_u = order[at : at + size_u]
            rows_p = rng.integers(0, len(positive), min(len(positive), 256))
            (fp, rp), (fu, ru) = take(p, rows_p), take(u, rows_u)
            zp = np.bincount(rp, w[fp], len(rows_p)) + bias
            zu = np.bincount(ru, w[fu], len(rows_u)) + bias
            # logistic losses: toxic log(1 + exp(-z)), clean log(1 + exp(z))
            clean_part = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
            if clean_part >= 0:
                dp, du = prior * (sp - 1) / len(zp) - prior * sp / len(zp), su / len(zu)
            else:
                dp, du = prior * sp / len(zp), -su / len(zu)
            g = np.append(np.bincount(fp, dp[rp], len(chosen)) + np.bincount(fu, du[ru], len(chosen)) + decay * w, dp.sum() + du.sum())
            k += 1
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
            w, bias = w - step[:-1], bias - step[-1]
    weights[chosen] = w
    return Classifier(weights, float(bias))


def held_out(doc_id: F.Column) -> F.Column:
    """Rows whose crc32 of the id as text is a multiple of 5; learning leaves them out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None, top: int = FEATURES) -> Classifier:
    """Fit on at most ``positives`` confirmed toxic and ``unlabelled`` other training texts.

    The class prior is the share of toxic rows among the labelled training rows
    unless it is given. A doc_id with several labels counts as toxic if one says so;
    null labels and null ids teach nothing.
    """
    texts = needed(docs, doc_id="long", text="string").where("doc_id is not null and text is not null").where(~held_out(F.col("doc_id")))
    known = needed(labels, doc_id="long", toxic="int").where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1)), F.lit(0))).first()
    prior = prior if prior is not None else min(0.5, max(0.01, (toxic + 1) / (n + 2)))
    by_hash = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = known.where("toxic = 1").orderBy(*by_hash).limit(positives).select("doc_id")
    other = texts.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(unlabelled)
    wanted = picked.withColumn("toxic", F.lit(True)).unionByName(other.withColumn("toxic", F.lit(False)))
    sample = cut(texts.join(F.broadcast(wanted), "doc_id").select("toxic", "text"))
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    chosen = np.array(_best_features(sample, n_p, n_u, prior, top), np.int64)
    # of a text only the chosen features reach the driver
    schema = pa.schema([("toxic", pa.bool_()), ("features", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                rows = [r.astype("<u4").tobytes() for r in distinct_features(part.column("text"), chosen)]
                yield from as_batches([{"toxic": part.column("toxic"), "features": rows}], schema)

    sides: dict[bool, list[np.ndarray]] = {True: [], False: []}
    # a stable order, however the rows arrive
    for is_toxic, raw in sorted((r["toxic"], bytes(r["features"])) for r in map_arrow(sample, run, "toxic boolean, features binary").collect()):
        sides[is_toxic].append(np.frombuffer(raw, "<u4").astype(np.int64))
    return fit_nnpu(sides[True], sides[False], chosen, prior)


def _best_features(sample: DataFrame, n_p: int, n_u: int, prior: float, top: int) -> list[int]:
    """The ``top`` usable features of the sample by gain, in ascending order; counted over the executors, of which each sends sums by feature."""
    schema = pa.schema([("feature", pa.int64()), ("df_p", pa.int64()), ("df_u", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                toxic = part.column("toxic").to_numpy(zero_copy_only=False)
                rows = distinct_features(part.column("text"))
                every = np.concatenate([np.zeros(0, np.int64), *rows])
                mark = np.repeat(toxic, [len(r) for r in rows])
                feature, at = np.unique(every, return_inverse=True)
                df_p = np.bincount(at, mark, len(feature)).astype(np.int64)
                yield from as_batches([{"feature": feature, "df_p": df_p, "df_u": np.bincount(at, minlength=len(feature)) - df_p}], schema)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gain, usable = choose_features(batch.column("df_p").to_numpy(), batch.column("df_u").to_numpy(), n_p, n_u, prior)
            yield pa.RecordBatch.from_arrays([batch.column("feature"), pa.array(gain, pa.float64())], names=["feature", "gain"]).filter(pa.array(usable))

    sums = map_arrow(sample, count, "feature long, df_p long, df_u long").groupBy("feature").agg(F.sum("df_p").alias("df_p"), F.sum("df_u").alias("df_u"))
    best = map_arrow(sums.where("df_p >= 3"), judged, "feature long, gain double").orderBy(F.desc("gain"), "feature").limit(top)
    return sorted(r["feature"] for r in best.collect())


def score_toxicity(docs: DataFrame, classifier: Classifier, threshold: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (0 to 1), predicted, and the columns to ``carry`` as a struct ``carried``.

    A null or empty text has no features and gets the score that the bias alone
    gives. Repeated rows get equal scores. held_out is false for a null id.
    """
    weights = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(classifier.weights), classifier.weights[classifier.weights != 0]))
    bias = classifier.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values = weights.value
        full = np.zeros(1 << BITS, np.float32)
        full[at] = values
        model = Classifier(full, bias)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                rest = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], pa.array(model.score(part.column("text")), pa.float64())], names=[*rest, "score"])

    more = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more) if carry else needed(docs, doc_id="long", text="string")
    kept = ", ".join(f"{name} {kind}" for name, kind in texts.dtypes if name != "text")
    scored = map_arrow(texts, run, f"{kept}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *["carried"] * bool(carry))


def crc_bucket(doc_id: int) -> int:
    """The same remainder in Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 5
