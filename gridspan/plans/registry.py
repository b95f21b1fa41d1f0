"""How queries are registered: name -> DataFrame builder, and the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None):
    """Add a query builder, with its oracle where SQL can express it."""

    def put(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return put
