"""Where registered queries and their SQL meet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under ``name``, with the same result as DuckDB SQL where that can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values_sql(rows: list[tuple], columns: str) -> str:
    """A VALUES list as a table expression."""
    cell = lambda v: "null" if v is None else quoted(v) if isinstance(v, str) else str(v)
    return "(values " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") {columns}"
