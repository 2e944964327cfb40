"""Registry of the queries the driver runs, each with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name; ``sql`` is its DuckDB equivalent."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give a scan at least one partition per core.

    Large tables have many splits and pass through untouched. A small file
    is one split, and per-row mapping work on it would run on one core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def dealt(df: DataFrame, per_core: int = 4) -> DataFrame:
    """Rows of a scan dealt evenly, for work that costs far more than to move them.

    A row group may be longer than many splits: the splits are many then, but few have rows.
    """
    return df.repartition(max(per_core * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def ntz(col) -> F.Column:
    """An instant as the plain timestamp DuckDB shows (session zone UTC)."""
    return (F.col(col) if isinstance(col, str) else col).cast("timestamp_ntz")
