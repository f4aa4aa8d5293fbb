"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logweir.llm import filter_audit, html_extract, jaccard_join, licenses, line_dedup, media, mixing, packing, phrases, quality_rules, suffix_dedup, toxicity, vector_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.op1,
        "op2_ngram_jaccard_join": jaccard_join.op2,
        "op3_mixing": mixing.op3,
        "op4_suffix_array_dedup": suffix_dedup.op4,
        "op5_html_extraction": html_extract.op5,
        "op6_embedding_near_dedup": vector_dedup.op6,
        "op7_packing": packing.op7,
        "op8_media_columns": media.op8,
        "op10_license_scans": licenses.op10,
        "op11_filter_audit": filter_audit.op11,
        "op12_phrase_mining": phrases.op12,
        "op13_quality_rules": quality_rules.op13,
        "op9_toxicity": toxicity.op9,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.OP1_SQL,
        "op3_mixing": mixing.OP3_SQL,
        "op11_filter_audit": filter_audit.OP11_SQL,
        "op12_phrase_mining": phrases.OP12_SQL,
    }
