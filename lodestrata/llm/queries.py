"""The subpackage's queries for ``__spark_entry__``: one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import byte_bpe, centroids, decontamination, exact_dedup, hard_negatives, langid, line_dedup, near_dedup, quality, secrets, suffix_dedup, token_counts, toxicity

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_secret_scans": secrets.op6_secret_scans,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_language_id": langid.op9_language_id,
    "op10_byte_bpe": byte_bpe.op10_byte_bpe,
    "op11_centroids": centroids.op11_centroids,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_exact_dedup": exact_dedup.op13_exact_dedup,
}

ORACLES: dict[str, str] = {"op1_quality_rules": quality.ORACLE, "op5_line_dedup": line_dedup.ORACLE, "op13_exact_dedup": exact_dedup.ORACLE}
