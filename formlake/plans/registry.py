"""Where plan modules record their queries and the SQL stating the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table, read as it lies; a session may ask for one-file tables to be dealt out over its slots."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    slots = spark.conf.get("formlake.read.partitions", None)
    return df.repartition(int(slots)) if slots else df


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL of its result where SQL can state it."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register
