"""Structured Streaming: a micro-batch is an epoch; its end closes it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import keyed_delta, output_delta
from ..operators.staging import shared_dir
from ..operators.zset import ZSet
from .inputs import Input, StreamingInput, Subscription, collected  # noqa: F401
from .stateful import blocking_aggregate, distinct, lookups, state_machine, streaming_aggregate  # noqa: F401


def epochs_of_files(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_per_epoch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_epoch).format(kind).load(path)


def subscribe(stream: DataFrame, on_epoch: Callable[[DataFrame, int], None], checkpoint: str | None = None, once: bool = True) -> StreamingQuery:
    """on_epoch(rows, epoch) after each epoch, empty ones of a running query left out. once: all that is there, then stop."""
    writer = stream.writeStream.foreachBatch(on_epoch)
    writer = writer.option("checkpointLocation", checkpoint) if checkpoint else writer
    return (writer.trigger(availableNow=True) if once else writer).start()


def subscribe_workers(stream: DataFrame, on_rows: Callable[[int, int, Iterator], None], checkpoint: str | None = None) -> StreamingQuery:
    """on_rows(epoch, partition, rows) on the workers."""

    def each(rows: DataFrame, epoch: int) -> None:
        def part(i: Iterator) -> None:
            from pyspark import TaskContext

            on_rows(epoch, TaskContext.get().partitionId(), i)

        rows.foreachPartition(part)

    return subscribe(stream, each, checkpoint)


def running_counts(stream: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Counts over all epochs; write in update mode for those that an epoch changes."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def windowed_counts(stream: DataFrame, ts: str, length: str, late: str, keys: list[str], name: str = "n") -> DataFrame:
    """Counts by window of event time; rows later than `late` are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, length), *keys).agg(F.count(F.lit(1)).alias(name))


def _stored(spark: SparkSession, folder: str, kind: str) -> dict[int, str]:
    """Complete tables of a kind by epoch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}-*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    names = [f.getPath().getParent() for f in found or []]
    return {int(n.getName().rsplit("-", 1)[1]): n.toString() for n in names}


def changes(stream: DataFrame, operator: Callable[[ZSet], ZSet], emit: Callable[[DataFrame, int], None], checkpoint: str | None = None, keys: list[str] | None = None, fold: int = 16) -> StreamingQuery:
    """emit(insertions and retractions of the operator's result, epoch), for a stream of records or of weighted records.

    keys: of an operator that works key by key; then only the input's keys that the epoch touches are computed, before and after. Else
    the result of each epoch is stored, and the next one computed anew and compared. The input's changes are stored by epoch and folded
    into one table every `fold` epochs. All lies under the checkpoint: after a restart the state is read from there, and an epoch that
    is told again writes the same tables and emits the same changes. Without a checkpoint nothing outlives the query.
    """
    spark, schema = stream.sparkSession, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema if f.name != "weight") + ", weight long"
    folder = f"{checkpoint.rstrip('/')}/loomtide" if checkpoint else f"{shared_dir(spark)}/loomtide/changes-{uuid.uuid4().hex}"

    def read(paths: list[str], schema) -> ZSet:
        return ZSet(spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema))

    def each(rows: DataFrame, epoch: int) -> None:
        folded, parts = ({e: p for e, p in _stored(spark, folder, kind).items() if e < epoch} for kind in ("input", "change"))
        base = max(folded, default=-1)
        before = read([folded[base] for _ in range(base >= 0)] + [p for e, p in sorted(parts.items()) if e > base], schema)
        change = (ZSet(rows) if "weight" in rows.columns else ZSet.of(rows)).consolidate()
        change.df.write.mode("overwrite").parquet(f"{folder}/change-{epoch}")
        change = read([f"{folder}/change-{epoch}"], schema)
        if keys:
            emit(keyed_delta(before, change, keys, operator).df, epoch)
        else:
            result = operator(before.concat(change)).consolidate()
            result.df.write.mode("overwrite").parquet(f"{folder}/result-{epoch}")
            results = {e: p for e, p in _stored(spark, folder, "result").items() if e < epoch}
            old = read([results[max(results)]] if results else [], result.df.schema)
            emit(output_delta(old, read([f"{folder}/result-{epoch}"], result.df.schema)).df, epoch)
        if epoch - base >= fold:
            before.concat(change).consolidate().df.write.mode("overwrite").parquet(f"{folder}/input-{epoch}")

    return subscribe(stream, each, checkpoint)
