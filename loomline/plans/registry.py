"""Queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function as a query, with its SQL where SQL can express it."""

    def held(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return held


from . import file_queries, function_queries, post_queries, stream_queries, table_queries, text_queries  # noqa: E402,F401
