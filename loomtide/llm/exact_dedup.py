"""Exact dedup as a tree merge of sorted digest runs. DataFrame functions only.

Every row's digest goes to one of `runs` leaf runs, by its doc_id. A run is sorted by digest; a round merges 2**fan_bits neighbouring
runs into one: sorted, they meet in sort aggregates, equal digests become one, and the smallest doc_id and the count go on. Equality is
verified at every level: rows merge only if digest, byte length and a second, independent 64-bit hash agree. Rounds are binomial: as
runs get fewer, each is dealt over more tasks by digest, so that tasks stay as many and as large. After log(runs)/fan_bits rounds one
run holds each group's verdict, which goes down the tree to the leaves and so to the rows. A hot digest has one row per leaf run at
most from the first round on, and its rows are spread over all leaf runs, so no task receives a hot group. Only digests are shuffled,
never texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import SPACE, salt, stage

KEY = ["digest", "n_bytes", "check"]


def digests(docs: DataFrame, runs: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select(
        "doc_id", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"), F.octet_length("t").alias("n_bytes"), F.xxhash64("t").alias("check"), salt("doc_id", runs).alias("run"))


def exact_dedup(docs: DataFrame, runs: int = 256, fan_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs.

    Null and empty texts are equal to each other. Equal texts keep the smallest doc_id; rows that repeat a doc_id and its text share
    its verdict, and each counts in group_size. A null doc_id never wins over a number; if all are null, keep_id is null and the rows
    are kept. An empty table gives an empty result. Other columns of docs are not read.
    """
    rows = stage(digests(docs, runs, id_col, text_col), "digests")
    least = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))  # a struct, whose minimum Spark takes over sorted rows, run by run
    leaf = rows.groupBy(*KEY, "run").agg(F.min(least).alias("least"), F.count(F.lit(1)).alias("n"))
    merged, left = leaf, runs
    while left > 1:
        merged = merged.withColumn("run", F.shiftright("run", fan_bits)).groupBy(*KEY, "run").agg(F.min("least").alias("least"), F.sum("n").alias("n"))
        left = -(-left // (1 << fan_bits))
    groups = stage(merged.filter("n > 1").select(*KEY, F.col("least.id").alias("keep_id"), F.col("n").alias("group_size")), "groups")
    down = leaf.select(*KEY, "run").join(groups, KEY)  # to the leaves: a row per group and run
    got = rows.alias("r").join(down.alias("d"), [*KEY, "run"], "left")
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return got.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
