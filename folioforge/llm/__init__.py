"""Operators for training data. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from . import op1_sentencepiece, op2_language, op3_license, op4_jaccard, op5_chat, op6_media, op7_decontaminate, op8_toxicity, op9_substrings, op10_tokens, op11_whitening, op12_setsketch, op13_clusters

MODULES = [op1_sentencepiece, op2_language, op3_license, op4_jaccard, op5_chat, op6_media, op7_decontaminate, op8_toxicity, op9_substrings, op10_tokens, op11_whitening, op12_setsketch, op13_clusters]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: f for m in MODULES for k, f in m.ORACLES.items()}
