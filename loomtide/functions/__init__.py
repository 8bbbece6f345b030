"""Column functions that the programs share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column | str) -> Column:
    """Split at single spaces; empty words stay."""
    return F.split(text, " ", -1)


def mex(values: Column) -> Column:
    """The least number from 0 on that isn't in an array."""
    return F.array_min(F.array_except(F.sequence(F.lit(0), F.size(values)), values))


def squared_distance(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
