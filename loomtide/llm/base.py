"""What the operators share: staged tables in the cluster's shared folder and checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import shared_dir, stage, unstage  # noqa: F401

#: White space of the contracts: [\x20\x09-\x0D]; exactly what bytes.split() splits at.
SPACE = r"[\x20\x09-\x0D]+"


def small(df: DataFrame, rows: int, lists: str | None = None) -> tuple[bool, DataFrame]:
    """Whether df has at most `rows` rows of fixed size, and df with a broadcast hint if so. df should be a staged table.

    lists: a column of lists; then a quarter of `rows` may be broadcast, with `rows` items in all, so that bytes are bounded alike.
    """
    most = rows // 4 if lists else rows
    fits = df.limit(most + 1).count() <= most
    if fits and lists:
        fits = (df.agg(F.sum(F.size(lists))).first()[0] or 0) <= rows
    return fits, F.broadcast(df) if fits else df


def salt(col: str | Column, n: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")


def row_ids(docs: DataFrame, id_col: str, name: str, broadcast_rows: int = 1_000_000) -> tuple[DataFrame, bool]:
    """docs with a column `name`, a long that no other row has; and whether it differs from the id anywhere.

    It is the id, but where that is null or repeated: such rows are numbered beyond all ids, in a staged table, so that a task that is
    run again finds the same numbers. Ids are counted, not texts, before anything is dealt by id.
    """
    given = F.col(id_col).cast("long")
    ids = docs.select(given.alias("given"))
    odd = stage(ids.groupBy("given").count().filter("count > 1 OR given IS NULL").select("given"), "odd_ids")
    if odd.isEmpty():
        return docs.withColumn(name, given), False
    low, high = ids.agg(F.min("given"), F.max("given")).first()
    number = F.monotonically_increasing_id()
    number = F.lit(high or 0) + 1 + number if (high or 0) < 1 << 62 else F.lit(low) - 1 - number  # ids at both ends of the range of longs overflow, which is an error
    odd = small(odd, broadcast_rows)[1].select(F.col("given").alias("#odd"), F.lit(True).alias("#is"))
    marked = docs.withColumn(name, given).join(odd, F.col(name).eqNullSafe(F.col("#odd")), "left")
    return stage(marked.withColumn(name, F.when(F.col("#is"), number).otherwise(F.col(name))).drop("#odd", "#is"), "rows"), True


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer parts than there are cores, dealt over all of them by its first column; others as they are. For operators that take long on a row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, df.columns[0]) if df.rdd.getNumPartitions() < cores else df


def release() -> None:
    """Give memory that Python has freed back to the system, so that an idle worker holds little beside the executor."""
    import contextlib
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow, with release() at the end of the task."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir. From here on Arrow batches of this session hold 4 MB (by default 64 MB, several times over in a task)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
