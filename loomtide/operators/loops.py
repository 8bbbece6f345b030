"""Loops run from the driver; every iterate is a staged table, so that plans stay short and a lost executor costs one iteration at most."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage
from .zset import ZSet

Step = Callable[[DataFrame], DataFrame]


def iterates(start: DataFrame, step: Step, n: int, enters: Column | None = None, partition: str | None = None) -> Iterator[DataFrame]:
    """The loop's back edge: step of the start, then of what came out, n + 1 times. enters: the iteration at which a record joins the loop
    (0: from the start). partition: a column that what goes back is dealt by. Ends before, when nothing is left and nothing can join."""
    now = start if enters is None else start.filter(enters == 0)
    for i in range(n + 1):
        if i and enters is not None:
            now = now.unionByName(start.filter(enters == i))
        now = stage(step(now.repartition(partition) if partition else now), "iterate")
        yield now
        if enters is None and now.isEmpty():
            return


def exit_loop(rounds: Iterable[DataFrame], k: int = 0) -> DataFrame:
    """What leaves a loop: the records of all iterations from k on, as a bag; none if the loop ended before."""
    kept, last = [], None
    for i, last in enumerate(rounds):
        if i >= k:
            kept.append(last)
    return reduce(DataFrame.unionByName, kept) if kept else last.limit(0)


def iterate(start: DataFrame, step: Step, n: int, enters: Column | None = None) -> DataFrame:
    """step applied n + 1 times. enters: the iteration at which a record joins the loop (0: from the start)."""
    *_, last = iterates(start, step, n, enters)
    return last


def iterate_and_accumulate(start: DataFrame, step: Step, n: int, enters: Column | None = None) -> DataFrame:
    """All iterates of step, as a bag; ends after n + 1 steps or when an iterate is empty."""
    return exit_loop(iterates(start, step, n, enters))


def fixed_point(start: ZSet, step: Callable[[ZSet], ZSet], max_iterations: int | None = None, strict: bool = True) -> ZSet:
    """The limit of step(step(... start)): ends when an iterate equals the one before.

    max_iterations = m gives step applied m + 1 times at most (None: as often as it takes); strict: an error if that is no fixed point.
    """
    now = ZSet(stage(start.consolidate().df, "fixed"))
    for _ in count() if max_iterations is None else range(max_iterations + 1):
        after = ZSet(stage(step(now).consolidate().df, "fixed"))
        if after.except_(now).consolidate().df.isEmpty():
            return after
        now = after
    if strict:
        raise RuntimeError(f"no fixed point in {max_iterations + 1} iterations")
    return now


def general_fixed_point(start: ZSet, step: Callable[[ZSet], ZSet], priority: Column, max_iterations: int | None = None) -> ZSet:
    """fixed_point for a step that keeps its input; records enter in waves by priority, each wave once the one before has come to rest."""
    start = ZSet(stage(start.df.withColumn("#wave", priority), "waves"))
    now: ZSet | None = None
    for wave in sorted(r[0] for r in start.df.select("#wave").distinct().collect()):  # one row for each priority
        fresh = ZSet(start.df.filter(F.col("#wave") == wave).drop("#wave"))
        now = fixed_point(fresh if now is None else now.concat(fresh), step, max_iterations)
    return now if now is not None else ZSet(start.df.drop("#wave"))


def _sent(fresh: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, value): the least value that comes along edges from fresh nodes."""
    return fresh.join(edges, fresh["node"] == edges["src"]).select(F.col("dst").alias("node"), "value").groupBy("node").agg(F.min("value").alias("value"))


def improved(best: DataFrame, fresh: DataFrame, edges: DataFrame, fold: int = 8, max_iterations: int | None = None) -> DataFrame:
    """best (node, value), a row a node, after `fresh` values, which are in it, have been sent along edges as far as they improve anything.

    A round joins only what the last one improved; improvements are kept as tables of their own, and folded into best every `fold`
    rounds, so that a round rewrites few rows however many nodes there are.
    """
    layers = [best]
    for i in count():
        if max_iterations is not None and i >= max_iterations:
            raise RuntimeError(f"no fixed point in {max_iterations} iterations")
        sent, known = _sent(fresh, edges), layers[0]
        for layer in layers[1:]:
            known = known.unionByName(layer)
        old = known.join(sent.select("node"), "node", "left_semi").groupBy("node").agg(F.min("value").alias("old"))
        fresh = stage(sent.join(old, "node", "left").filter("old IS NULL OR value < old").select("node", "value"), "improved")
        if fresh.isEmpty():
            return known.groupBy("node").agg(F.min("value").alias("value")) if len(layers) > 1 else known
        layers.append(fresh)
        if len(layers) > fold:
            layers = [stage(known.unionByName(fresh).groupBy("node").agg(F.min("value").alias("value")), "values")]


def propagate_min(values: DataFrame, edges: DataFrame, max_iterations: int | None = None) -> DataFrame:
    """(node, value): the least value that reaches each node along edges (src, dst), values (node, value) included. Only what improved is sent on."""
    best = stage(values.groupBy("node").agg(F.min("value").alias("value")), "values")
    return improved(best, best, edges, max_iterations=max_iterations)


def propagate_min_again(best: DataFrame, values: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The result of propagate_min(values, edges + added - removed), from that of (.., edges), which is best: only what the change touches is computed.

    values: of all nodes, new ones included. Nodes that have their value only by way of a removed edge are found along edges that carry
    it, lose it, and take anew what their own value and the other nodes' edges give; then what is new is sent on, with the added edges.
    All edges are sets of (src, dst); removed ones are in edges, added ones aren't.
    """
    left = stage(edges.select("src", "dst").join(removed.select("src", "dst"), ["src", "dst"], "left_anti"), "edges")
    now = stage(left.unionByName(added.select("src", "dst")), "edges")
    own = values.groupBy("node").agg(F.min("value").alias("own"))
    both = stage(best.join(own, "node", "left").withColumn("held", F.col("own").isNotNull() & (F.col("own") <= F.col("value"))), "held")  # by itself
    ends = both.filter("NOT held").select(F.col("node").alias("dst"), F.col("value").alias("v"))
    carried = lambda e, start: e.join(start.select(F.col("node").alias("src"), "value"), "src").join(ends, "dst").filter("v = value").select(F.col("dst").alias("node"), F.col("v").alias("value")).distinct()
    lost = fresh = stage(carried(removed.select("src", "dst"), best), "lost")
    while not fresh.isEmpty():
        fresh = stage(carried(left, fresh).join(lost.select("node"), "node", "left_anti"), "lost")
        lost = lost.unionByName(fresh)
    lost = stage(lost.select("node"), "lost")
    kept = best.join(lost, "node", "left_anti")
    start = own.join(kept.select("node"), "node", "left_anti").select("node", F.col("own").alias("value"))  # of lost and new nodes
    into = _sent(kept, now.join(lost.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    again = stage(start.unionByName(into).groupBy("node").agg(F.min("value").alias("value")), "again")
    new = stage(kept.unionByName(again), "values")
    first = _sent(new, added.select("src", "dst")).withColumnRenamed("value", "sent").join(new, "node", "left").filter("value IS NULL OR sent < value").select("node", F.col("sent").alias("value"))
    fresh = stage(first.unionByName(again).groupBy("node").agg(F.min("value").alias("value")), "again")
    merged = stage(new.unionByName(fresh).groupBy("node").agg(F.min("value").alias("value")), "values")
    return improved(merged, fresh, now)
