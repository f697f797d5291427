"""Thresholds and weights used across jobs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    # Results depend on each of these.
    direction_confidence: float = 0.99
    rule_confidence: float = 0.98
    review_threshold: float = 0.70
    min_similarity: float = 0.58
    enrich_similarity: float = 0.68
    enrich_fallback_similarity: float = 0.80
    direct_similarity: float = 0.90
    direct_mapping_confidence: float = 0.82
    direct_confidence_cap: float = 0.99
    second_opinion_threshold: float = 0.60
    lexical_candidates: int = 15
    dense_candidates: int = 15
    rerank_candidates: int = 20
    fusion_k: int = 20
    lexical_weight: float = 0.8
    dense_weight: float = 1.0
    seed_weight: float = 4.0
    lookup_limit: int = 8
    record_aliases: int = 16
    min_query_chars: int = 3
    use_second_opinion: bool = False
    use_tokens: bool = True


DEFAULTS = Options()
