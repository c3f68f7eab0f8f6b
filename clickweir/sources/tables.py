"""Stored tables: scans bounded in time, views and ad-hoc SQL."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..functions.times import between


def scan(spark: SparkSession, path: str, column: str = "timestamp", start=None, end=None) -> DataFrame:
    """Rows of a table in ``[start, end)``; the bounds reach the Parquet reader and prune date partitions."""
    return between(spark.read.parquet(path), column, start, end)


def register_views(tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def adhoc_sql(spark: SparkSession, text: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Run SQL text over the given tables."""
    register_views(tables)
    return spark.sql(text)
