"""Queries of the training-data operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, embedding_dedup, filter_audit, fingerprints, html_text, line_dedup, near_dedup, packing, quality_rules, sentencepieces, sharding, substring_dedup, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_embedding_dedup": embedding_dedup.op2_embedding_dedup,
    "op3_html_text": html_text.op3_html_text,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op4_sentencepieces": sentencepieces.op4_sentencepieces,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_packing": packing.op6_packing,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_sharding": sharding.op8_sharding,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_collocations": collocations.op12_collocations,
    "op13_fingerprints": fingerprints.op13_fingerprints,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE_SQL,
    "op2_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op10_near_dedup": near_dedup.ORACLE_SQL,
    "op5_substring_dedup": substring_dedup.ORACLE_SQL,
    "op8_sharding": sharding.ORACLE_SQL,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
    "op12_collocations": collocations.ORACLE_SQL,
}
