"""Names of queries, and the same questions in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[f.__name__] = f
    if sql:
        SQL[f.__name__] = sql


def query(sql: str | None = None):
    def put(f):
        add(f, sql)
        return f

    return put


def literal(v) -> str:
    """A value as SQL."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
