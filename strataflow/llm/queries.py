"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataflow.llm import bpe, chat, decontaminate, divergence, html, lloyd, mixing, ordinal, quality, secrets, simhash, suffix_tree, warc
from strataflow.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(query: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: query(spark, *(table(spark, sf_dir, t) for t in tables))


QUERIES: dict[str, Query] = {
    "op1_byte_bpe": _over(bpe.query, "documents"),
    "op2_suffix_tree_lm": _over(suffix_tree.query, "documents"),
    "op3_html_text": _over(html.query, "pages"),
    "op4_ordinal_quality": _over(ordinal.query, "documents", "labels"),
    "op5_tool_calls": _over(chat.query, "conversations"),
    "op6_simhash_golay": _over(simhash.query, "documents"),
    "op7_quality_rules": _over(quality.query, "documents", "labels"),
    "op8_secret_scan": _over(secrets.query, "documents"),
    "op9_decontamination": _over(decontaminate.query, "documents", "benchmark"),
    "op10_warc": _over(warc.query, "pages"),
    "op11_source_divergence": _over(divergence.query, "documents"),
    "op12_delta_lloyd": _over(lloyd.query, "embeddings"),
    "op13_source_mix": _over(mixing.query, "documents"),
}

ORACLE_SQL: dict[str, str] = {"op5_tool_calls": chat.ORACLE, "op11_source_divergence": divergence.ORACLE, "op12_delta_lloyd": lloyd.ORACLE, "op13_source_mix": mixing.ORACLE}
