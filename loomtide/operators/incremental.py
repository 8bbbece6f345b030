"""Maintenance of results under changes: a log of weighted changes by epoch, and rules for what changes of inputs do to outputs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage
from .zset import ZSet


class DeltaLog:
    """An input that changes by epochs. on_next() closes an epoch; state() is all changes so far, folded into a snapshot."""

    def __init__(self, empty: ZSet, keep: int = 16):
        self.epoch, self.snapshot, self.changes, self.keep = -1, empty, [], keep

    def on_next(self, change: ZSet | DataFrame | None = None) -> int:
        """Weighted records, plain records (weight 1) or nothing; the number of the epoch."""
        self.epoch += 1
        if change is not None:
            self.changes.append(change if isinstance(change, ZSet) else ZSet.of(change))
        if len(self.changes) >= self.keep:  # compaction
            self.snapshot, self.changes = ZSet(stage(self.state().df, "snapshot")), []
        return self.epoch

    def state(self) -> ZSet:
        out = self.snapshot
        for c in self.changes:
            out = out.concat(c)
        return out.consolidate()


def join_delta(a: ZSet, da: ZSet, b: ZSet, db: ZSet, left: str | Sequence[str], right: str | Sequence[str], *result) -> ZSet:
    """Change of a join of a and b, as they were, when da and db come: da*b + a*db + da*db."""
    return da.join(b.concat(db), left, right, *result).concat(a.join(db, left, right, *result)).consolidate()


def keyed_delta(a: ZSet, da: ZSet, keys: Sequence[str], operator: Callable[[ZSet], ZSet]) -> ZSet:
    """Change of an operator that works key by key (count, sum, min, max, distinct, group_by ...): only keys that da touches are computed, before and after."""
    touched = da.df.select(*keys).distinct()
    on = lambda z: ZSet(z.df.alias("l").join(touched.alias("t"), [F.col(f"l.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys], "left_semi"))
    return operator(on(a.concat(da))).except_(operator(on(a))).consolidate()


def output_delta(before: ZSet, after: ZSet) -> ZSet:
    """Insertions and retractions between two results, for loops, which are run anew."""
    return after.except_(before).consolidate()
