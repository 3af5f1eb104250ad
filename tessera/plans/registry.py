"""Where plans enter their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add(name: str, sql: str | None = None):
    """Register a query under a name of its own, with SQL that gives the same rows."""
    def entered(f):
        if name in QUERIES:
            raise ValueError(f"there is a query {name} already")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return entered
