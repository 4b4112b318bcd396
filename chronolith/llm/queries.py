"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import bpe, chat, decontaminate, filter_audit, html_text, near_dup, secrets, sharding, topk, toxicity, url_filter, variants, word_bpe

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_chat": chat.op2_chat,
    "op3_bpe": bpe.op3_bpe,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_url_filters": url_filter.op5_url_filters,
    "op6_html_text": html_text.op6_html_text,
    "op7_sharding": sharding.op7_sharding,
    "op8_topk": topk.op8_topk,
    "op9_secrets": secrets.op9_secrets,
    "op10_near_dup": near_dup.op10_near_dup,
    "op11_word_bpe": word_bpe.op11_word_bpe,
    "op12_spelling_variants": variants.op12_spelling_variants,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLES = {
    "op1_decontamination": decontaminate.ORACLE,
    "op5_url_filters": url_filter.ORACLE,
    "op8_topk": topk.ORACLE,
    "op10_near_dup": near_dup.ORACLE,
    "op12_spelling_variants": variants.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
