"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from weftline.llm import html_text, line_dedup, line_rules, log_bilinear, mixing, neighbours, packing, quality, simhash, token_blocks

QUERIES = {
    "op1_token_blocks": token_blocks.op1_token_blocks,
    "op2_html_text": html_text.op2_html_text,
    "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
    "op4_quality_scores": quality.op4_quality_scores,
    "op5_log_bilinear": log_bilinear.op5_log_bilinear,
    "op6_line_quality_rules": line_rules.op6_line_quality_rules,
    "op7_systematic_mix": mixing.op7_systematic_mix,
    "op8_learned_partitions": neighbours.op8_learned_partitions,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}
SQL: dict[str, str] = {
    "op7_systematic_mix": mixing.SQL_OP7,
    "op9_line_dedup": line_dedup.SQL_OP9,
}
