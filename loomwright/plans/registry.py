"""All queries over the driver tables with their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "flt_04_top_05"
Query = Callable[[SparkSession, str], DataFrame]


def _catalogs():
    from . import explorer_queries, graph_queries, message_queries, more_queries, relational_queries, store_queries, text_queries

    return [relational_queries.CATALOG, text_queries.CATALOG, message_queries.CATALOG, graph_queries.CATALOG, more_queries.CATALOG, explorer_queries.CATALOG, store_queries.CATALOG]


def queries() -> dict[str, Query]:
    return {name: q for c in _catalogs() for name, (q, _) in c.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for c in _catalogs() for name, (_, sql) in c.items() if sql}
