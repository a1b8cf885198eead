"""All registered queries of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import consultation_queries, graph_queries, question_queries, retrieval_queries, source_queries, state_queries, text_queries

_MODULES = (text_queries, retrieval_queries, graph_queries, question_queries, state_queries, consultation_queries, source_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
