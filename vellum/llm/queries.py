"""The ten operators' queries and the pipeline's, as the driver registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from vellum.llm import chat_format, decontaminate, host_quality, html_extract, licence_scan, lm_score, packing, secret_scan, simhash, sstable

Query = Callable[[SparkSession, str], DataFrame]

_ALL: dict[str, tuple[Query, str | None]] = {
    "op1_licence_scan": (licence_scan.query, licence_scan.SQL),
    "op2_host_quality": (host_quality.query, host_quality.SQL),
    "op3_sstable": (sstable.query, None),
    "op4_secret_scan": (secret_scan.query, None),
    "op5_simhash": (simhash.query, None),
    "op6_html_extract": (html_extract.query, None),
    "op7_lm_score": (lm_score.query, None),
    "op8_packing": (packing.query, None),
    "op9_decontaminate": (decontaminate.query, decontaminate.SQL),
    "op10_chat_format": (chat_format.query, chat_format.SQL),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
