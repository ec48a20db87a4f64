"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, exact_dedup, html_extraction, language_id, license_scan, ngram_join, packing, quality, substring_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard": ngram_join.op1_ngram_jaccard,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_packing": packing.op3_packing,
        "op4_substring_dedup": substring_dedup.op4_substring_dedup,
        "op5_license_scan": license_scan.op5_license_scan,
        "op6_quality": quality.op6_quality,
        "op7_html_extraction": html_extraction.op7_html_extraction,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_language_id": language_id.op9_language_id,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard": ngram_join.ORACLE,
        "op4_substring_dedup": substring_dedup.ORACLE,
        "op8_decontamination": decontamination.ORACLE,
        "op10_exact_dedup": exact_dedup.ORACLE,
    }
