"""The queries of this folder and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import byte_bpe, chat_format, html_lstm, imatch, line_dedup, positional_index, ppm_language, simhash_bktree, sstable, url_rules

OPERATORS = {
    "op1_chat_format": chat_format,
    "op2_simhash_bktree": simhash_bktree,
    "op3_imatch": imatch,
    "op4_url_rules": url_rules,
    "op5_ppm_language": ppm_language,
    "op6_sstable": sstable,
    "op7_html_lstm": html_lstm,
    "op8_line_dedup": line_dedup,
    "op9_positional_index": positional_index,
    "op10_byte_bpe": byte_bpe,
}


def queries() -> dict:
    return {name: module.query for name, module in OPERATORS.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE for name, module in OPERATORS.items() if getattr(module, "ORACLE", None)}
