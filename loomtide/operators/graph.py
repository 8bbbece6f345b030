"""Graph operators: edges (src, dst), node values (node, value)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def transmit_along(values: DataFrame, edges: DataFrame, value: Column | None = None) -> DataFrame:
    """(node, value) at the end of every edge from a node with a value; `value` may use value and dst. Parallel edges send again."""
    sent = values.join(edges, values["node"] == edges["src"])
    return sent.select(F.col("dst").alias("node"), (F.col("value") if value is None else value).alias("value"))


def node_aggregate(values: DataFrame, combine: Callable[[Column], Column] = F.sum) -> DataFrame:
    """One value for each node that has any."""
    return values.groupBy("node").agg(combine(F.col("value")).alias("value"))


def graph_reduce(values: DataFrame, edges: DataFrame, combine: Callable[[Column], Column] = F.sum, value: Column | None = None) -> DataFrame:
    return node_aggregate(transmit_along(values, edges, value), combine)


def count_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node").agg(F.count(F.lit(1)).alias("value"))


def distinct_nodes(nodes: DataFrame) -> DataFrame:
    """Each node once, over all epochs."""
    return nodes.select("node").dropDuplicates()


def filter_by(values: DataFrame, nodes: DataFrame) -> DataFrame:
    return values.join(nodes.select("node"), "node", "left_semi")


def node_join(values: DataFrame, states: DataFrame, result: Column, default: Column) -> DataFrame:
    """(node, value) with `result` of value and state; nodes without a state (node, state) have the default."""
    return values.join(states, "node", "left").withColumn("state", F.coalesce("state", default)).select("node", result.alias("value"))


def state_machine(values: DataFrame, states: DataFrame, fold: Callable[[Column], Column], transition: Column, output: Column | None = None, default: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """One epoch of state machines on nodes: (new states, outputs).

    An epoch's values of a node are folded by an aggregate into `value`; transition and output may use it and the old `state` (default:
    null). Without an output, the new state is put out where it changed. States belong to nodes, not to epochs: hand them on.
    """
    folded = values.groupBy("node").agg(fold(F.col("value")).alias("value"))
    both = states.join(folded, "node", "full").withColumn("state", F.coalesce("state", F.lit(None) if default is None else default))
    moved = both.withColumn("#new", F.when(F.col("value").isNull(), F.col("state")).otherwise(transition))
    put = moved.filter("value IS NOT NULL")
    put = put.filter(~F.col("#new").eqNullSafe(F.col("state"))).select("node", F.col("#new").alias("value")) if output is None else put.select("node", output.alias("value"))
    return moved.select("node", F.col("#new").alias("state")), put


def dense_names(names: DataFrame, col: str = "name", per: int = 1 << 33) -> DataFrame:
    """(name, node): distinct, dense numbers from 0, without sorting all names in one task: a count by partition, then ranks within."""
    from pyspark.sql import Window

    from .staging import stage

    one = names.select(F.col(col).alias("name")).filter("name IS NOT NULL").dropDuplicates()
    numbered = stage(one.withColumn("#id", F.monotonically_increasing_id()).select("name", F.floor(F.col("#id") / per).alias("#part"), (F.col("#id") % per).alias("#rank")), "names")
    sizes = numbered.groupBy("#part").agg(F.count(F.lit(1)).alias("#n"))  # a row for each partition
    before = sizes.withColumn("#before", F.coalesce(F.sum("#n").over(Window.orderBy("#part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("#part", "#before")
    return numbered.join(F.broadcast(before), "#part").select("name", (F.col("#before") + F.col("#rank")).cast("long").alias("node"))


def rename_using(rows: DataFrame, mapping: DataFrame, col: str, to: str = "node") -> DataFrame:
    """rows whose name in `col` has a number, with it."""
    named = mapping.select(F.col("name").alias("#name"), F.col("node").alias(to))
    return rows.join(named, rows[col] == named["#name"]).drop("#name")


def rename_edges(edges: DataFrame, mapping: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return rename_using(rename_using(edges, mapping, src, "#src"), mapping, dst, "#dst").select(F.col("#src").alias("src"), F.col("#dst").alias("dst"))


def rename_nodes(nodes: DataFrame, mapping: DataFrame, col: str = "name") -> DataFrame:
    return rename_using(nodes, mapping, col).drop(col)


class AutoRenamer:
    """Numbers for names of several inputs, the same name having the same number in all."""

    def __init__(self) -> None:
        self.inputs: list[DataFrame] = []

    def add(self, rows: DataFrame, *cols: str) -> AutoRenamer:
        self.inputs += [rows.select(F.col(c).alias("name")) for c in cols]
        return self

    def final(self) -> DataFrame:
        from functools import reduce

        return dense_names(reduce(DataFrame.union, self.inputs))
