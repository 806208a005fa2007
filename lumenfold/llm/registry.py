"""Queries of the training-data operators and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from lumenfold.llm import alignment, chat, fim, html_extract, mixing, pieces, pii, quality_model, quality_rules, simhash, token_output, topk, toxicity

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_html_extraction": html_extract.op2_html_extraction,
    "op3_token_output": token_output.op3_token_output,
    "op4_mixing": mixing.op4_mixing,
    "op5_simhash": simhash.op5_simhash,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_exact_topk": topk.op7_exact_topk,
    "op8_quality_classifier": quality_model.op8_quality_classifier,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_chat_formatting": chat.op10_chat_formatting,
    "op11_alignment": alignment.op11_alignment,
    "op12_pii": pii.op12_pii,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}
ORACLE_SQL = {
    "op1_quality_rules": quality_rules.SQL,
    "op7_exact_topk": topk.SQL,
    "op10_chat_formatting": chat.SQL,
    "op13_fill_in_middle": fim.SQL,
}
