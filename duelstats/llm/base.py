"""Registry of the operators' queries, and table reading."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from duelstats.session import cut, scratch_path, shuffles_freed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def small(df: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The table written down, and whether it has at most ``most`` rows, so that it may be broadcast."""
    kept = cut(df)
    return kept, kept.limit(most + 1).count() <= most


def land(df: DataFrame) -> DataFrame:
    """``cut`` with zstd, for tables that hold whole texts."""
    path = scratch_path(df.sparkSession, "land")
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
