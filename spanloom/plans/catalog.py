"""All queries over the shared tables, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import array_queries, model_queries, row_queries, source_queries, text_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return text_queries.queries() | array_queries.queries() | source_queries.queries() | row_queries.queries() | model_queries.queries()


def oracle_sql() -> dict[str, str]:
    return text_queries.oracle_sql() | array_queries.oracle_sql() | source_queries.oracle_sql() | row_queries.oracle_sql() | model_queries.oracle_sql()
