"""All queries by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_claims, queries_text


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return queries_claims.QUERIES | queries_text.QUERIES


def oracle_sql() -> dict[str, str]:
    return queries_claims.SQL | queries_text.SQL
