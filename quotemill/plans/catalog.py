"""All queries of the core, by name, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quotemill.plans import cleaning, reference


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return reference.QUERIES | cleaning.QUERIES


def oracle_sql() -> dict[str, str]:
    return reference.ORACLE | cleaning.ORACLE
