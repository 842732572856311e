"""Named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, tables) under its name; ``tables("orders")`` reads a table."""

    def add(f):
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        run.__doc__ = f.__doc__
        QUERIES[key] = run
        if sql:
            ORACLES[key] = sql
        return f

    return add
