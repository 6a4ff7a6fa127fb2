"""The corpus operators' queries and the SQL that checks those it can express."""

from __future__ import annotations

from . import embedding_dedup, language_id, line_dedup, mixing, packing, quality_classifier, quality_rules, simhash, suffix_dedup, token_files

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_language_id": language_id.op2_language_id,
    "op3_simhash": simhash.op3_simhash,
    "op4_token_files": token_files.op4_token_files,
    "op6_packing": packing.op6_packing,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_mixing": mixing.op8_mixing,
    "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}
ORACLES = {
    "op1_suffix_dedup": suffix_dedup.OP1_SQL,
    "op9_embedding_dedup": embedding_dedup.OP9_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
}
