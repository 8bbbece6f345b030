"""Inputs that a program feeds epoch by epoch, and subscriptions to what is computed from them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import shared_dir, stage

OnEpoch = Callable[[DataFrame, int], None]


class Subscription:
    """What `build` computes from an input, one micro-batch an epoch. folder holds the checkpoint; a subscription of the same folder goes on after a restart."""

    def __init__(self, source: Input, build: Callable[[DataFrame], DataFrame], on_epoch: OnEpoch, mode: str, folder: str, on_completed: Callable[[], None] | None):
        self.source, self.build, self.on_epoch, self.mode, self.folder, self.on_completed, self.done = source, build, on_epoch, mode, folder, on_completed, -1
        source.spark.createDataFrame([], source.schema).write.mode("ignore").parquet(f"{folder}/in")

    def _result(self) -> DataFrame:
        return self.build(self.source.spark.readStream.schema(self.source.schema).parquet(f"{self.folder}/in"))

    def _deliver(self, rows: DataFrame | None, epoch: int) -> None:
        result, told = self._result(), []
        if rows is not None:
            rows.write.mode("append").parquet(f"{self.folder}/in")
            query = result.writeStream.outputMode(self.mode).foreachBatch(lambda got, _: told.append(stage(got, "told")))
            query.option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        now = self.source.spark.createDataFrame([], result.schema)
        for part in told:  # a micro-batch, and one that a watermark adds
            now = now.unionByName(part)
        self.on_epoch(now, epoch)
        self.done = epoch

    def sync(self, epoch: int) -> None:
        """Return when the epoch and all before it are through; an error if it hasn't been fed."""
        if epoch > self.done:
            raise ValueError(f"epoch {epoch} hasn't been fed yet")


class Input:
    """on_next() feeds the next epoch, and returns when all subscriptions are through with it. Epochs are kept: one who subscribes late gets them all."""

    def __init__(self, spark: SparkSession, schema: str, folder: str | None = None):
        self.spark, self.schema, self.folder = spark, schema, folder or f"{shared_dir(spark)}/loomtide/input-{uuid.uuid4().hex}"
        self.epochs: list[DataFrame | None] = []
        self.subscriptions: list[Subscription] = []
        self.frontier: list[Callable[[int | None], None]] = []
        self.completed = False

    def subscribe(self, on_epoch: OnEpoch, build: Callable[[DataFrame], DataFrame] = lambda rows: rows, mode: str = "append", name: str | None = None, on_completed: Callable[[], None] | None = None) -> Subscription:
        """on_epoch(result rows, epoch) for each epoch, empty ones too. mode: append, update or complete, as Spark's."""
        got = Subscription(self, build, on_epoch, mode, f"{self.folder}/{name or uuid.uuid4().hex}", on_completed)
        for epoch, rows in enumerate(self.epochs):
            got._deliver(rows, epoch)
        self.subscriptions.append(got)
        return got

    def on_next(self, rows: DataFrame | None = None) -> int:
        """Records of the next epoch, or none; the epoch's number."""
        if self.completed:
            raise ValueError("the input is completed")
        kept = None if rows is None else stage(rows, "epoch")
        self.epochs.append(None if kept is None or kept.isEmpty() else kept)
        epoch = len(self.epochs) - 1
        for s in self.subscriptions:
            s._deliver(self.epochs[-1], epoch)
        for f in self.frontier:
            f(epoch + 1)
        return epoch

    def on_completed(self, rows: DataFrame | None = None) -> None:
        """No further epochs; records, if given, are the last one."""
        if rows is not None:
            self.on_next(rows)
        self.completed = True
        for s in self.subscriptions:
            if s.on_completed:
                s.on_completed()
        for f in self.frontier:
            f(None)

    def on_frontier(self, f: Callable[[int | None], None]) -> None:
        """f(the least epoch that is still open) when it moves; None after the last."""
        self.frontier.append(f)


class StreamingInput:
    """Records of epochs in any order: they are held until their epoch is closed, then handed on in order of the epochs. Later ones are counted and dropped."""

    def __init__(self, to: Input):
        self.to, self.held, self.late = to, {}, 0

    def on_recv(self, rows: DataFrame, epoch: int) -> None:
        rows = stage(rows, "pending")
        if epoch < len(self.to.epochs):
            self.late += rows.count()
        else:
            self.held.setdefault(epoch, []).append(rows)

    def on_notify(self, epoch: int) -> None:
        """The epoch and all before it are closed."""
        while len(self.to.epochs) <= epoch:
            parts = self.held.pop(len(self.to.epochs), [])
            rows = None
            for p in parts:
                rows = p if rows is None else rows.unionByName(p)
            self.to.on_next(rows)


def collected(path: str) -> OnEpoch:
    """An on_epoch that writes each epoch's rows to a folder of its own; an epoch that is told again is replaced."""
    return lambda rows, epoch: rows.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{path}/{epoch:08d}")
