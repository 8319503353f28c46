"""Every query by name, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.plans import answer_queries, capture_queries, code_queries, file_queries, finding_queries, log_queries, rank_queries, report_queries, review_queries, stream_queries, tool_queries

_MODULES = (log_queries, file_queries, rank_queries, review_queries, code_queries, capture_queries, finding_queries, report_queries, stream_queries, answer_queries, tool_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
