"""Queries of the text-preparation operators, registered when this subpackage is present."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import oracles
from tidemark.llm import queries as q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_chat_format": q.op1_chat_format,
    "op2_toxicity": q.op2_toxicity,
    "op3_near_dup": q.op3_near_dup,
    "op4_top_k": q.op4_top_k,
    "op5_bpe": q.op5_bpe,
    "op6_line_dedup": q.op6_line_dedup,
    "op7_mixing": q.op7_mixing,
    "op8_pii": q.op8_pii,
    "op9_url_filter": q.op9_url_filter,
    "op10_fingerprint": q.op10_fingerprint,
    "op11_packing": q.op11_packing,
    "op12_periodic": q.op12_periodic,
    "op13_alignment": q.op13_alignment,
}
ORACLE_SQL: dict[str, str] = dict(oracles.ORACLE_SQL)
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
