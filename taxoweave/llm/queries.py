"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import jaccard, katz, licenses, mixing, packing, quality, substring, urlfilter, vectors


def queries() -> dict:
    return {
        "op1_substring_dedup": substring.op1_substring_dedup,
        "op2_url_filters": urlfilter.op2_url_filters,
        "op3_exact_topk": vectors.op3_exact_topk,
        "op4_hash_prefix_forest": vectors.op4_hash_prefix_forest,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_quality_classifier": quality.op6_quality_classifier,
        "op7_katz_scores": katz.op7_katz_scores,
        "op8_ngram_jaccard": jaccard.op8_ngram_jaccard,
        "op8_ngram_jaccard_pairs": jaccard.op8_ngram_jaccard_pairs,
        "op9_mixing": mixing.op9_mixing,
        "op10_license_scans": licenses.op10_license_scans,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring.ORACLE,
        "op2_url_filters": urlfilter.ORACLE,
        "op3_exact_topk": vectors.ORACLE_3,
        "op8_ngram_jaccard": jaccard.ORACLE,
        "op8_ngram_jaccard_pairs": jaccard.ORACLE_PAIRS,
        "op9_mixing": mixing.ORACLE,
    }
