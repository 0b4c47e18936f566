"""Queries of the corpus operators and, where SQL can express one, its DuckDB oracle."""

from graphloom.llm import decontaminate, host_rules, html_text, importance, language_model, line_dedup, mixing, near_dedup, quality, suffix_dedup, token_counts, toxicity, turn_repair

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_decontaminate": decontaminate.query,
    "op4_token_counts": token_counts.query,
    "op5_mix_sources": mixing.query,
    "op6_near_dedup": near_dedup.query,
    "op7_html_text": html_text.query,
    "op8_quality": quality.query,
    "op9_line_dedup": line_dedup.query,
    "op10_host_rules": host_rules.query,
    "op11_turn_repair": turn_repair.query,
    "op12_language_model": language_model.query,
    "op13_importance": importance.query,
}

ORACLES = {
    "op2_suffix_dedup": suffix_dedup.ORACLE,
    "op3_decontaminate": decontaminate.ORACLE,
    "op5_mix_sources": mixing.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
    "op10_host_rules": host_rules.ORACLE,
    "op11_turn_repair": turn_repair.ORACLE,
    "op13_importance": importance.ORACLE,
}
