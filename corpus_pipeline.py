"""The corpus pipeline: each stage reads the Parquet table that the one before it wrote.

Every stage works on all rows of its predecessor and its decisions take effect.
Rows are never dropped but by a stage's own verdict. Each row is judged by its own
text; only near-dedup goes by doc_id, so there a row without one stays, and rows
that share one go together. Null and empty texts pass every stage; columns beside
those of documents are left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontam, near_dedup, pieces, pii, toxicity
from lattica.llm.queries import piece_model
from lattica.session import cut, ensure_checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _shaped(df: DataFrame) -> DataFrame:
    """The columns of documents, whatever else a row carries."""
    kinds = {"doc_id": "long", "n_chars": "long"}
    return df.select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go; it learns from the labels of the documents given. Each row is judged by its own text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = _shaped(docs)
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, labels), carry=COLUMNS)
    return scored.where("predicted = 0").select("carried.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, a similarity of 0.8 or more.

    Only rows whose id may be among the rejected ones, by a filter of a MB, go
    through the join; a row that the filter clears stays where it is.
    """
    docs = _shaped(docs)
    rejected = cut(near_dedup.near_duplicates(docs, k=5, percent=80).where("not kept").select("doc_id").distinct())
    marked = near_dedup.marked_ids(docs, "doc_id", rejected, "doc_id", "maybe")
    sure, maybe = marked.where("not maybe").drop("maybe"), marked.where("maybe").drop("maybe")
    return sure.select(*COLUMNS).union(maybe.join(rejected, "doc_id", "left_anti").select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which windows of benchmark items make up 5 % or more go; from the others, hit runs of more than 13 words are cut, and n_chars follows the text."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    left = decontam.remove_spans(_shaped(docs), benchmark, columns=COLUMNS, drop_contaminated=True)
    return left.withColumn("n_chars", F.when(F.col("n_cut") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in every text give way to their kinds; n_chars follows the text."""
    return pii.mask_spans(_shaped(docs), columns=("lang", "source", "n_chars")).select("doc_id", "text", "lang", "source", F.when(F.col("n_masked") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as piece ids with merge-dropout, and whether they decode to it."""
    return pieces.encode(docs, piece_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("pieces", encode_pieces),
]

#: Trained and seeded models take part in the stages, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
