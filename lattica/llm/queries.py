"""The queries of these operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """Where the public SentencePiece vocabulary lies; operators take a path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents: base patterns, and what the tagger adds."""
    from lattica.llm.pii import digest, find_personal_data

    return digest(find_personal_data(_table(spark, sf_dir, "documents")))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates over all documents: four-word shingles, a similarity of 0.8 or more."""
    from lattica.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op3_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document is kept by repetition, length and distance from its language."""
    from lattica.llm.quality import judge

    return judge(_table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op4_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as pieces with merge-dropout, and whether they decode to it."""
    from lattica.llm.pieces import encode

    return encode(_table(spark, sf_dir, "documents"), piece_model(), with_ids=False)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document, and whether it is contaminated."""
    from lattica.llm.decontam import find_contamination, judge

    return judge(find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of pieces of every document."""
    from lattica.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), piece_model())


def op7_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by rules, else by boosted trees."""
    from lattica.llm.url_filter import judge, rule_labels, train

    pages = _table(spark, sf_dir, "pages")
    return judge(pages, train(rule_labels(pages))).drop("block_score")


def op8_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: base patterns, and weak parts that stand together."""
    from lattica.llm.secrets import digest, find_secrets

    return digest(find_secrets(_table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document."""
    from lattica.llm.toxicity import score_toxicity, train

    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, _table(spark, sf_dir, "labels")))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from lattica.llm.html_extract import extract

    return extract(_table(spark, sf_dir, "pages"))


def byte_vocabulary() -> str:
    """Where the public byte-level vocabulary lies; operators take a path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of at most 2,048 tokens, packed into as few sequences as the plan reaches."""
    from lattica.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), byte_vocabulary(), with_ids=False)


def op12_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open sales of each nation, and of all (-2), at every moment at which they change."""
    from lattica.llm.concurrency import concurrency, sale_intervals

    found = concurrency(sale_intervals(*[_table(spark, sf_dir, t) for t in ("sales", "sale_lines", "clients")]))
    return found.withColumnsRenamed({"key": "nation_id", "open_weight": "open_cents"})


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove by part, at each step of all 120 orders."""
    from lattica.llm.filter_audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_personal_data": op1_personal_data,
        "op2_near_dedup": op2_near_dedup,
        "op3_divergence": op3_divergence,
        "op4_piece_dropout": op4_piece_dropout,
        "op5_decontamination": op5_decontamination,
        "op6_token_counts": op6_token_counts,
        "op7_url_trees": op7_url_trees,
        "op8_linked_secrets": op8_linked_secrets,
        "op9_toxicity": op9_toxicity,
        "op10_main_text": op10_main_text,
        "op11_bin_slack": op11_bin_slack,
        "op12_concurrency": op12_concurrency,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    from lattica.llm import oracles

    return {"op2_near_dedup": oracles.OP2, "op5_decontamination": oracles.OP5, "op12_concurrency": oracles.OP12, "op13_filter_audit": oracles.OP13}
