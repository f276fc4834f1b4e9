"""The query catalog: each query's Spark function and, where SQL can express it, the DuckDB SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import fields, mail, oracles, plan_calls, queries, runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(queries.QUERIES) | mail.QUERIES | fields.QUERIES | plan_calls.QUERIES | runs.QUERIES
ORACLE_SQL: dict[str, str] = dict(oracles.ORACLE_SQL) | mail.ORACLE_SQL | fields.ORACLE_SQL | plan_calls.ORACLE_SQL | runs.ORACLE_SQL
