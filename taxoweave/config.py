"""Limits and thresholds of the alignment, with the documented defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    batch_size: int = 25
    confidence: float = 0.7
    high_confidence: float = 0.8
    medium_confidence: float = 0.5
    keyword_jaccard: float = 0.15
    ngram_overlap: float = 0.2
    fuzzy_ratio: float = 0.4
    fuzzy_top: int = 50
    hierarchy_weight: float = 0.2
    hierarchy_most: float = 0.5
    vector_cosine: float = 0.3
    vector_top: int = 50
    backfill_top: int = 15
    candidates: int = 25
    smart_sure: float = 0.8
    smart_fuzzy: float = 0.6
    smart_translit: float = 0.7
    smart_partial: float = 0.5
    auto_ratio: float = 0.95
    auto_synonym: float = 0.9
    path_similarity: float = 0.3
    branch_context: int = 50
    branch_sample: int = 5
    vocabulary: int = 10_000
    most_df: float = 0.95
    cache_ttl_seconds: int = 3600
    cache_entries: int = 1000
    #: Reproduce the documented oddities instead of the corrected rules.
    compat: bool = False


DEFAULT = Settings()
