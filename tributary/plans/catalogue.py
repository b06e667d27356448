"""All registered queries of the engine with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tributary.plans import flow_queries, mart_queries, script_queries, statement_queries, syntax_queries

_PARTS = (mart_queries, statement_queries, script_queries, syntax_queries, flow_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: sql for part in _PARTS for k, sql in part.ORACLE_SQL.items()}
