"""All queries of the engine, by name, and the SQL of each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.plans import agents, operations, retrieval, service


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return retrieval.QUERIES | operations.QUERIES | service.QUERIES | agents.QUERIES


def oracle_sql() -> dict[str, str]:
    return retrieval.SQL | operations.SQL | service.SQL | agents.SQL
