"""Operators on streams of records by epoch: each works within an epoch, given by a column of that name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

E = "epoch"


def select(df: DataFrame, *exprs: Column | str) -> DataFrame:
    return df.select(E, *exprs)


def select_many(df: DataFrame, items: Column, name: str) -> DataFrame:
    return df.select(E, F.explode(items).alias(name))


def select_by_partition(df: DataFrame, *exprs: Column | str) -> DataFrame:
    return df.select(E, F.spark_partition_id().alias("partition"), *exprs)


def distinct(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """As sets."""
    return a.unionByName(b).dropDuplicates()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """As sets."""
    return a.select(b.columns).intersect(b)


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a, as often as they are there, that b doesn't hold in the epoch; null equals null."""
    right = b.dropDuplicates().alias("r")
    return a.alias("l").join(right, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in a.columns], "left_anti")


def join(a: DataFrame, b: DataFrame, left: Sequence[str], right: Sequence[str], *result: Column | str) -> DataFrame:
    on = [F.col(f"l.{x}").eqNullSafe(F.col(f"r.{y}")) for x, y in zip([E, *left], [E, *right], strict=True)]
    return a.alias("l").join(b.alias("r"), on).select(F.col(f"l.{E}").alias(E), *result)


def count(df: DataFrame, name: str = "n") -> DataFrame:
    """How often each record is there."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(name))


def aggregate(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    return df.groupBy(E, *keys).agg(*aggregates)


def minimum(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return aggregate(df, keys, F.min(value).alias(value))


def maximum(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return aggregate(df, keys, F.max(value).alias(value))


def group_by(df: DataFrame, keys: Sequence[str], reducer: Callable, schema: str) -> DataFrame:
    """reducer(pandas rows of an epoch and key) -> pandas rows."""
    return df.groupBy(E, *keys).applyInPandas(reducer, schema)


def co_group_by(a: DataFrame, b: DataFrame, left: Sequence[str], right: Sequence[str], reducer: Callable, schema: str) -> DataFrame:
    return a.groupBy(E, *left).cogroup(b.groupBy(E, *right)).applyInPandas(reducer, schema)


def per_partition(df: DataFrame, keys: Sequence[str], function: Callable, schema: str) -> DataFrame:
    """function(iterator of pandas batches) -> iterator, once for each partition by key."""
    return df.repartition(*keys).mapInPandas(function, schema)


def binary_expression(a: DataFrame, b: DataFrame, left: Sequence[str], right: Sequence[str], function: Callable, schema: str) -> DataFrame:
    """function(iterator of pandas batches) -> iterator, once for each partition; rows of a and b with equal keys are in one.

    A batch has the columns of both, those of the other side null, and #side: 0 for rows of a, 1 for rows of b.
    """
    keyed = lambda df, keys, side: df.select(*(F.col(k).alias(f"#key{i}") for i, k in enumerate(keys)), "*", F.lit(side).alias("#side"))
    both = keyed(a, left, 0).unionByName(keyed(b, right, 1), allowMissingColumns=True)
    names = [f"#key{i}" for i in range(len(left))]
    return both.repartition(*names).drop(*names).mapInPandas(function, schema)


def sliding_counts(df: DataFrame, keys: Sequence[str], n: int, name: str = "n") -> DataFrame:
    """Records by key in the window of each epoch and the n - 1 before it, for windows that hold any."""
    counted = df.groupBy(E, *keys).agg(F.count(F.lit(1)).alias("#n"))  # before rows are multiplied
    return counted.withColumn(E, F.explode(F.sequence(F.col(E), F.col(E) + n - 1))).groupBy(E, *keys).agg(F.sum("#n").alias(name))


def late(df: DataFrame, closed: Column | int) -> tuple[DataFrame, DataFrame]:
    """Rows of epochs after the last closed one, and the number of those that come too late."""
    closed = F.lit(closed) if isinstance(closed, int) else closed
    return df.filter(F.col(E) > closed), df.filter(F.col(E) <= closed).agg(F.count(F.lit(1)).alias("dropped"))


def lookup(puts: DataFrame, gets: DataFrame, key: str, value: str) -> DataFrame:
    """(epoch, key, value): for each request the last value put by its epoch; of one epoch's values the greatest. Requests without one are dropped."""
    from pyspark.sql import Window

    puts = puts.groupBy(E, key).agg(F.max(value).alias(value)).select(E, key, value, F.lit(0).alias("#get"))
    both = puts.unionByName(gets.select(E, key, F.lit(1).alias("#get")), allowMissingColumns=True)
    last = Window.partitionBy(key).orderBy(E, "#get").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(last)).filter((F.col("#get") == 1) & F.col(value).isNotNull()).select(E, key, value)
