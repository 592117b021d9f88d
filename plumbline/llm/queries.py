"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, chat, decontaminate, html, katz, lines, minhash, pii, quality, repair, simhash, spelling, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (urls.op1_url_filters, pii.op2_pii, quality.op3_quality_rules, lines.op4_line_dedup, minhash.op5_near_duplicates, decontaminate.op6_decontamination, katz.op7_katz_scoring, chat.op8_chat_formatting, bpe.op9_bpe, html.op10_html_extraction, spelling.op11_spelling_variants, repair.op12_conversation_repair, simhash.op13_simhash)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": urls.OP1_SQL, "op8_chat_formatting": chat.OP8_SQL}
