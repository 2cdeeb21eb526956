"""The registered queries of the engine and their equivalents in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def load() -> None:
    """Import the modules that register queries."""
    from graphloom.plans import chapter_queries, document_queries, fight_queries, forest_queries, graph_queries, lookup_queries, pipeline_queries, play_queries, record_queries, state_queries, text_queries, view_queries  # noqa: F401
