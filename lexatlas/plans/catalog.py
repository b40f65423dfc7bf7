"""Every operator bound to the test tables, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is left out where no SQL states the result."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def load() -> None:
    """Import the modules that register queries."""
    from lexatlas.plans import estimation_queries, map_queries, table_queries, topic_queries, vector_queries  # noqa: F401
