"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mensura.llm import fingerprints, media, mixing, neardup, packing, pii, ppm, quality, substrings, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substrings.query_with_passages,
    "op2_fingerprints": fingerprints.query,
    "op3_pii": pii.query,
    "op4_toxicity": toxicity.query,
    "op5_quality": quality.query,
    "op6_media": media.query,
    "op7_near_duplicates": neardup.query,
    "op8_packing": packing.query,
    "op9_mixing": mixing.query,
    "op10_lm_scoring": ppm.query,
}

ORACLE_SQL: dict[str, str] = {}
