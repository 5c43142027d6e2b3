"""Registered queries of the engine and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import corpus_queries, graph_queries, report_queries, search_queries

_FAMILIES = (search_queries, graph_queries, report_queries, corpus_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for family in _FAMILIES for name, f in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in _FAMILIES for name, sql in family.SQL.items()}
