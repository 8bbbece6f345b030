"""From documents to packed training sequences: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtide.llm import exact_dedup, jaccard_join, packing, quality_crf, substring_dedup
from loomtide.llm.base import row_ids, shared_dir, small, stage, table

#: No stage's models, chains or packing order can be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
#: Dropped rows up to this number are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
THRESHOLD = 0.7
#: A number for each row, which is its doc_id where that is there and not repeated: verdicts are on rows, never on ids that others share.
ROW = "#row"


def without(docs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """docs whose ROW is not in rows."""
    return docs.join(small(stage(rows, "dropped"), BROADCAST_ROWS)[1], ROW, "left_anti").select(columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and empty texts are scored as one empty line. Labels are met by doc_id, repeated or not."""
    model = quality_crf.train(docs, table(spark, sf_dir, "labels"))
    return quality_crf.score(docs, model, "#score").filter(F.col("#score") >= THRESHOLD).select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: of the smallest doc_id that no other row has, if there is one. Null and empty texts are equal."""
    rows, _ = row_ids(docs, "doc_id", ROW)
    return without(rows, exact_dedup.exact_dedup(rows, id_col=ROW).filter("NOT kept").select(F.col("doc_id").alias(ROW)), docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, as in exact(); texts without a word are in no group. Rows with one doc_id and other texts are other documents."""
    rows, _ = row_ids(docs, "doc_id", ROW)
    found = jaccard_join.near_duplicates(rows, id_col=ROW, unique=True)
    return without(rows, found.filter("component_id <> doc_id").select(F.col("doc_id").alias(ROW)), docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out of the row they were found in; the first occurrence stays. Texts that were nothing else go."""
    rows, _ = row_ids(docs, "doc_id", ROW)
    return substring_dedup.remove_passages(rows, substring_dedup.repeated_passages(rows, id_col=ROW, unique=True), id_col=ROW).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts in training sequences; null and empty texts are their end id alone, rows are packed each, whatever their doc_id."""
    return packing.digest(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("substring dedup", passages), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents after all STAGES; an empty table gives none. Columns beside doc_id, text and n_chars are carried along until packing."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/loomtide/pipeline-{uuid.uuid4().hex}"
    for i, (_, f) in enumerate(STAGES):
        f(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
