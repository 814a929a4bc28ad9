"""All checked queries, and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import check_features, check_models, check_more, check_normalize, check_plans, check_sources

PARTS = (check_normalize, check_features, check_models, check_plans, check_sources, check_more)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every registered query."""
    return {name: run for part in PARTS for name, run in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express."""
    return {name: text for part in PARTS for name, text in part.SQL.items()}
