"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from loomspan.llm import decontaminate, exact_dedup, html_text, language, line_dedup, manifest, ngram_join, packing, pii, repair, substring_dedup, token_counts, url_filter

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_language_id": language.op2_language_id,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_suffix_dedup": substring_dedup.op5_suffix_dedup,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_packing": packing.op7_packing,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_html_text": html_text.op9_html_text,
    "op10_pii": pii.op10_pii,
    "op11_conversation_repair": repair.op11_conversation_repair,
    "op12_manifest": manifest.op12_manifest,
    "op13_token_counts": token_counts.op13_token_counts,
}
ORACLE_SQL = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op3_url_filter": url_filter.OP3_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
    "op11_conversation_repair": repair.OP11_SQL,
    "op12_manifest": manifest.OP12_SQL,
}
