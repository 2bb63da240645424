"""Name, query and SQL of every registered query, kept side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` gives the same rows from the same tables in plain SQL."""

    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(column: Column | str, digits: int = 4) -> Column:
    """Double rounded for comparison, without a negative zero."""
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value.cast("double"), digits) + F.lit(0.0)


def as_long(column: Column | str) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return value.cast("bigint")
