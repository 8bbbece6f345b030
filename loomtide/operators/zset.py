"""Multisets of records with signed weights, as DataFrames with a `weight` column.

Linear operators (select, where, select_many, concat, except_, join) work on weights as they come; the others first
sum the weights of equal records. Records are equal if all columns are, null being equal to null. A weight of zero is absence.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

W = "weight"


def _cols(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


class ZSet:
    def __init__(self, df: DataFrame):
        if W not in df.columns:
            raise ValueError(f"no column {W}")
        self.df, self.cols = df.withColumn(W, F.col(W).cast("long")), [c for c in df.columns if c != W]

    @classmethod
    def of(cls, df: DataFrame, weight: int | Column = 1) -> ZSet:
        """Each row with the same weight, or a weight of its own."""
        return cls(df.withColumn(W, F.lit(weight) if isinstance(weight, int) else weight))

    # One input, record by record.
    def select(self, *exprs: Column | str) -> ZSet:
        return ZSet(self.df.select(*exprs, W))

    def where(self, condition: Column | str) -> ZSet:
        return ZSet(self.df.filter(condition))

    def select_many(self, items: Column, name: str) -> ZSet:
        """A record for each item of an array, in place of the record; use F.slice() for a segment of it."""
        return ZSet(self.df.select(F.explode(items).alias(name), W))

    def negate(self) -> ZSet:
        return ZSet(self.df.withColumn(W, -F.col(W)))

    def partition_by(self, *keys: str | Column, n: int | None = None) -> ZSet:
        return ZSet(self.df.repartition(n, *keys) if n else self.df.repartition(*keys))

    def monitor(self, name: str) -> ZSet:
        """The same records; a query over them reports how many there were and their net weight under `name`."""
        return ZSet(self.df.observe(name, F.count(F.lit(1)).alias("records"), F.sum(W).alias("net")))

    def adjust_time(self, to: Column, time: str = "epoch") -> ZSet:
        """Each record no earlier than `to` and than its own time."""
        return ZSet(self.df.withColumn(time, F.greatest(to, F.col(time))))

    # Weights of equal records.
    def consolidate(self, *partition: str | Column) -> ZSet:
        df = self.df.repartition(*partition) if partition else self.df
        return ZSet(df.groupBy(*self.cols).agg(F.sum(W).alias(W)).filter(F.col(W) != 0))

    def _map_net(self, to: Callable[[Column], Column]) -> ZSet:
        return ZSet(self.df.groupBy(*self.cols).agg(to(F.sum(W)).alias(W)).filter(F.col(W) != 0))

    def distinct(self) -> ZSet:
        return self._map_net(lambda w: F.when(w > 0, 1).otherwise(0))

    def abs(self) -> ZSet:
        return self._map_net(F.abs)

    # Two inputs.
    def concat(self, other: ZSet) -> ZSet:
        return ZSet(self.df.unionByName(other.df))

    def except_(self, other: ZSet) -> ZSet:
        """w1 - w2, which may be negative."""
        return self.concat(other.negate())

    def _pair_net(self, other: ZSet, to: Callable[[Column, Column], Column]) -> ZSet:
        both = self.df.withColumn("#side", F.lit(0)).unionByName(other.df.withColumn("#side", F.lit(1)))
        net = [F.coalesce(F.sum(F.when(F.col("#side") == s, F.col(W))), F.lit(0)) for s in (0, 1)]
        return ZSet(both.groupBy(*self.cols).agg(to(*net).alias(W)).filter(F.col(W) != 0))

    def union(self, other: ZSet) -> ZSet:
        return self._pair_net(other, F.greatest)

    def intersect(self, other: ZSet) -> ZSet:
        return self._pair_net(other, F.least)

    def symmetric_difference(self, other: ZSet) -> ZSet:
        return self._pair_net(other, lambda a, b: F.abs(a - b))

    def join(self, other: ZSet, left: str | Sequence[str], right: str | Sequence[str], *result: Column | str) -> ZSet:
        """Records with equal keys (null equals null); weights multiply. Columns of both sides are free in `result`, as l.x and r.x."""
        on = [F.col(f"l.{a}").eqNullSafe(F.col(f"r.{b}")) for a, b in zip(_cols(left), _cols(right), strict=True)]
        return ZSet(self.df.alias("l").join(other.df.alias("r"), on).select(*result, (F.col(f"l.{W}") * F.col(f"r.{W}")).alias(W)))

    # By key.
    def count(self, keys: str | Sequence[str], name: str = "n") -> ZSet:
        """Net number of records by key, where it is positive."""
        return ZSet.of(self.df.groupBy(*_cols(keys)).agg(F.sum(W).alias(name)).filter(F.col(name) > 0))

    def sum(self, keys: str | Sequence[str], value: Column | str, name: str = "total") -> ZSet:
        return self.aggregate(keys, **{name: value})

    def aggregate(self, keys: str | Sequence[str], **values: Column | str) -> ZSet:
        """Sums of weight times each value by key. A key stays unless its net weight and all its sums are zero."""
        sums = [F.sum(F.col(W) * (F.col(v) if isinstance(v, str) else v)).alias(n) for n, v in values.items()]
        stay = F.col("#net") != 0
        for n in values:
            stay = stay | (F.col(n) != 0)
        return ZSet.of(self.df.groupBy(*_cols(keys)).agg(F.sum(W).alias("#net"), *sums).filter(stay).drop("#net"))

    def _best(self, keys: str | Sequence[str], by: Column | str, pick: Callable) -> ZSet:
        first = F.struct(F.expr(by) if isinstance(by, str) else by, *self.cols)
        rows = self.consolidate().df.filter(F.col(W) > 0).groupBy(*_cols(keys)).agg(pick(F.struct(*self.cols), first).alias("#r"))
        return ZSet.of(rows.select(*(F.col(f"#r.{c}").alias(c) for c in self.cols)))

    def min(self, keys: str | Sequence[str], by: Column | str) -> ZSet:
        """The whole record with the least `by` for each key; ties go to the least record."""
        return self._best(keys, by, F.min_by)

    def max(self, keys: str | Sequence[str], by: Column | str) -> ZSet:
        """The whole record with the greatest `by` for each key; ties go to the greatest record."""
        return self._best(keys, by, F.max_by)

    def expanded(self) -> DataFrame:
        """A row for each unit of positive net weight; a weight over 1,000,000 is repeated in several lists, so that none is too long."""
        step = 1_000_000
        parts = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col(W) - 1) / step)), lambda i: F.least(F.lit(step), F.col(W) - i * step).cast("int"))
        rows = self.consolidate().df.filter(F.col(W) > 0).select(*self.cols, F.explode(parts).alias("#n"))
        return rows.select(*self.cols, F.explode(F.array_repeat(F.lit(0), F.col("#n"))).alias("#i")).drop("#i")

    def group_by(self, keys: str | Sequence[str], reducer: Callable, schema: str) -> ZSet:
        """reducer(pandas rows of a key, one for each unit of weight) -> pandas rows; records with no positive weight are not seen."""
        return ZSet.of(self.expanded().groupBy(*_cols(keys)).applyInPandas(reducer, schema))

    def group_weighted(self, keys: str | Sequence[str], reducer: Callable, schema: str) -> ZSet:
        """The same, with a row for each record and its weight instead of a row for each unit. A key's records lie in one Python worker."""
        return ZSet(self.consolidate().df.filter(F.col(W) > 0).groupBy(*_cols(keys)).applyInPandas(reducer, schema))

    def co_group_by(self, other: ZSet, left: str | Sequence[str], right: str | Sequence[str], reducer: Callable, schema: str) -> ZSet:
        """reducer(rows, other rows) -> rows for each key of either side; an absent side is empty."""
        return ZSet.of(self.expanded().groupBy(*_cols(left)).cogroup(other.expanded().groupBy(*_cols(right))).applyInPandas(reducer, schema))

    def co_group_weighted(self, other: ZSet, left: str | Sequence[str], right: str | Sequence[str], reducer: Callable, schema: str) -> ZSet:
        """The same, with a row for each record and its weight instead of a row for each unit."""
        a, b = (z.consolidate().df.filter(F.col(W) > 0) for z in (self, other))
        return ZSet(a.groupBy(*_cols(left)).cogroup(b.groupBy(*_cols(right))).applyInPandas(reducer, schema))

    # Epochs.
    def sliding_window(self, n: int, time: str = "epoch") -> ZSet:
        """Changes of a window of n epochs: each record comes at its epoch and goes n epochs later."""
        return self.except_(ZSet(self.df.withColumn(time, F.col(time) + n)))

    def accumulated(self, until: int, time: str = "epoch") -> ZSet:
        """What holds at the end of an epoch: all changes up to it, without the time."""
        return ZSet(self.df.filter(F.col(time) <= until).drop(time)).consolidate()
