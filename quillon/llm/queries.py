"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from quillon.llm import bpe, classifier, jaccard, licenses, lines, lm, media, mixing, quality_rules, token_counts

QUERIES = {
    "op1_lines": lines.op1_lines,
    "op2_lm": lm.op2_lm,
    "op3_mix": mixing.op3_mix,
    "op4_tokens": token_counts.op4_tokens,
    "op5_media": media.op5_media,
    "op6_bpe": bpe.op6_bpe,
    "op7_jaccard": jaccard.op7_jaccard,
    "op8_quality": classifier.op8_quality,
    "op9_licenses": licenses.op9_licenses,
    "op10_rules": quality_rules.op10_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op1_lines": lines.OP1_SQL,
    "op2_lm": lm.OP2_SQL,
    "op3_mix": mixing.OP3_SQL,
    "op7_jaccard": jaccard.OP7_SQL,
}
