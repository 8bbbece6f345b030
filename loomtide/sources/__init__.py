"""Readers and writers of files by epoch; any store that Spark has a file system for."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def constant(spark: SparkSession, rows: Iterable, schema: str, epoch: int = 0) -> DataFrame:
    """Given records, all in one epoch."""
    return spark.createDataFrame(list(rows), schema).withColumn("epoch", F.lit(epoch))


def batches(spark: SparkSession, parts: Iterable[Iterable], schema: str) -> DataFrame:
    """Each batch is the next epoch; empty ones count."""
    fields = ", ".join(["epoch long", schema])
    return spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, part in enumerate(parts) for r in part], fields)


def read_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A row for each line, the last included; a file named twice is read once."""
    paths = list(dict.fromkeys([path] if isinstance(path, str) else path))
    return spark.read.text(paths).withColumnRenamed("value", "line")


def read_edges(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(src, dst) of lines of two numbers; lines that begin with # are comments."""
    parts = F.split(F.trim("line"), r"\s+")
    return read_text(spark, path).filter(~F.col("line").startswith("#") & (F.trim("line") != "")).select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"))


def decoded(files: DataFrame, decode: Callable[[bytes], Iterable[tuple]], schema: str, most: int = 10_000) -> DataFrame:
    """Records that decode() finds in each `content`, in batches of at most `most`."""

    def run(parts):
        from itertools import islice

        import pandas as pd

        names = [c.split()[0] for c in schema.split(",")]
        for part in parts:
            for content in part["content"]:
                rows = iter(decode(bytes(content)))
                while some := list(islice(rows, most)):
                    yield pd.DataFrame(some, columns=names)

    return files.select("content").mapInPandas(run, schema)


def read_binary(spark: SparkSession, path: str, decode: Callable[[bytes], Iterable[tuple]], schema: str, glob: str | None = None) -> DataFrame:
    """Records that decode() finds in each file."""
    reader = spark.read.format("binaryFile")
    return decoded((reader.option("pathGlobFilter", glob) if glob else reader).load(path), decode, schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table(spark: SparkSession, options: dict, where: str | None = None) -> DataFrame:
    """Rows of a database table; the filter goes to the database."""
    rows = spark.read.format("jdbc").options(**options).load()
    return rows.filter(where) if where else rows


def write_text(df: DataFrame, path: str, col: str = "line") -> None:
    df.select(F.col(col).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_by_epoch(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A folder for each epoch; those that are written again are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").format(kind).save(path)


def write_by_worker(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A folder for each epoch and, in it, each task that has rows of it."""
    write = df.withColumn("worker", F.spark_partition_id()).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    write.partitionBy("epoch", "worker").format(kind).save(path)


def write_table(df: DataFrame, options: dict) -> None:
    df.write.format("jdbc").options(**options).mode("append").save()
