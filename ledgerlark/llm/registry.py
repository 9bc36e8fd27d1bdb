"""The operators' queries and, where SQL can say them, their DuckDB twins."""

from __future__ import annotations

from . import bpe, centroids, exact_dedup, fingerprints, hard_negatives, language_id, nearest, ngram_join, packing, pii, substring_dedup, suffix_dedup, url_filter

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_bpe": bpe.op2_bpe,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_language_id": language_id.op4_language_id,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_nearest": nearest.op6_nearest,
    "op7_packing": packing.op7_packing,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_pii": pii.op9_pii,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_fingerprints": fingerprints.op12_fingerprints,
    "op13_centroids": centroids.op13_centroids,
}

ORACLE_SQL = {
    "op3_url_filter": url_filter.ORACLE_SQL,
    "op6_nearest": nearest.ORACLE_SQL,
    "op10_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
    "op13_centroids": centroids.ORACLE_SQL,
}
