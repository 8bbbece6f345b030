"""Partitioning hints and a check of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def partition_by(df: DataFrame, *keys: str | Column, n: int | None = None) -> DataFrame:
    return df.repartition(n, *keys) if n else df.repartition(*keys)


def single(df: DataFrame) -> DataFrame:
    """All rows in one task; for results known to be small."""
    return df.coalesce(1)


def violations(df: DataFrame, *keys: str) -> DataFrame:
    """Keys whose rows lie in more than one partition."""
    return df.withColumn("#p", F.spark_partition_id()).groupBy(*keys).agg(F.count_distinct("#p").alias("partitions")).filter("partitions > 1")
