"""The library's named queries."""

from __future__ import annotations

from lattica.plans import ann_queries, candidate_queries, graph_queries, packed_queries, phrase_queries, registry, report_queries, retrieval_queries, sample_queries, store_queries, text_queries, text_triple_queries, tier_queries, variant_queries


def all_queries() -> dict[str, registry.Query]:
    return registry.QUERIES


def all_oracles() -> dict[str, str]:
    return registry.ORACLES


__all__ = ["all_oracles", "all_queries", "ann_queries", "candidate_queries", "graph_queries", "packed_queries", "phrase_queries", "report_queries", "retrieval_queries", "sample_queries", "store_queries", "text_queries", "text_triple_queries", "tier_queries", "variant_queries"]
