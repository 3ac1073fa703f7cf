"""Queries of this subpackage by name, with the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from terraframe.llm import decontaminate, html_extract, jaccard_join, language_id, line_dedup, quality_rules, secret_scan, sentence_pieces, substring_dedup, suffix_dedup

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_sentence_pieces": sentence_pieces.op3_sentence_pieces,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_language_id": language_id.op7_language_id,
    "op8_suffix_array_dedup": suffix_dedup.op8_suffix_array_dedup,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_html_extract": html_extract.op10_html_extract,
}
#: The others are tested against brute force, a round trip or held-out accuracy.
ORACLE_SQL = {
    "op1_decontaminate": decontaminate.SQL,
    "op5_line_dedup": line_dedup.SQL,
    "op6_substring_dedup": substring_dedup.SQL,
    "op8_suffix_array_dedup": suffix_dedup.SQL,
    "op9_jaccard_join": jaccard_join.SQL,
}
