"""The operators' queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_tree, jaccard_join, packing, preference_format, quality_crf, quality_rules, sentencepieces, substring_dedup, training_order
from .base import spread, table

#: Where the public tokenizer files are; a parameter, never copied.
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model: str = PIECES) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = sentencepieces.decode(sentencepieces.encode(docs, model), model)
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit("▁"), F.lit(" "))
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), same.alias("round_trip"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(documents(spark, sf_dir))


def op6_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_format.digest(preference_format.preference_format(preference_format.reply_pairs(table(spark, sf_dir, "conversations"))))


def op7_packing(spark: SparkSession, sf_dir: str, tokenizer: str = WORDS) -> DataFrame:
    return packing.digest(packing.pack(documents(spark, sf_dir), tokenizer))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.host_rules(documents(spark, sf_dir)).drop("host")


def op9_training_order(spark: SparkSession, sf_dir: str, tokenizer: str = WORDS) -> DataFrame:
    return training_order.materialise(documents(spark, sf_dir), tokenizer)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_html_text, op3_quality, op4_exact_dedup, op5_substring_dedup, op6_preferences, op7_packing, op8_host_rules, op9_training_order, op10_jaccard_join)}
SQL = {"op4_exact_dedup": exact_dedup.SQL, "op6_preferences": preference_format.SQL, "op8_host_rules": quality_rules.SQL}
