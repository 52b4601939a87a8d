"""Queries and SQL of this subpackage, for the entry module."""

from __future__ import annotations

from ruleloom.llm import bagminhash, brown, decontaminate, licenses, linededup, mixing, multiindex, paragraphs, suffixdedup, toxicity

QUERIES = {
    "op2_inverted_multi_index": multiindex.op2_inverted_multi_index,
    "op7_suffix_array_dedup": suffixdedup.op7_suffix_array_dedup,
    "op6_paragraph_dedup": paragraphs.op6_paragraph_dedup,
    "op8_line_dedup": linededup.op8_line_dedup,
    "op1_license_scan": licenses.op1_license_scan,
    "op9_entropy_mixing": mixing.op9_entropy_mixing,
    "op4_bagminhash_near_dedup": bagminhash.op4_bagminhash_near_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op10_brown_lm_scoring": brown.op10_brown_lm_scoring,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
}
ORACLE_SQL = {
    "op8_line_dedup": linededup.OP8_SQL,
    "op1_license_scan": licenses.OP1_SQL,
    "op3_benchmark_decontamination": decontaminate.OP3_SQL,
}
