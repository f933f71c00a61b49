"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from evalspark.llm import byte_bpe, collocations, html_text, line_dedup, minhash, packing, quality_model, quality_rules, substring_dedup, token_counts, url_filter, vector_codes, vector_graph
from evalspark.llm.line_sql import LINES, PASSAGES

QUERIES = {
    "op1_byte_bpe": byte_bpe.query,
    "op2_quality_model": quality_model.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_quality_rules": quality_rules.query,
    "op5_packing": packing.query,
    "op6_minhash": minhash.query,
    "op7_html_text": html_text.query,
    "op8_url_filter": url_filter.query,
    "op9_vector_graph": vector_graph.query,
    "op10_line_dedup": line_dedup.query,
    "op11_vector_codes": vector_codes.query,
    "op12_token_counts": token_counts.query,
    "op13_collocations": collocations.query,
}

ORACLE_SQL = {
    "op3_substring_dedup": PASSAGES,
    "op4_quality_rules": quality_rules.ORACLE_SQL,
    "op8_url_filter": url_filter.ORACLE_SQL,
    "op10_line_dedup": LINES,
    "op11_vector_codes": vector_codes.ORACLE_SQL,
    "op13_collocations": collocations.ORACLE_SQL,
}
