"""Rules on words and lines, and verdicts on hosts: failures by host, shrunk by an empirical beta prior, joined back to documents."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import salt, small, stage, tidy

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """COUNTS of one text; null and empty texts have none."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()
    chars = len(b"".join(words).decode())
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.split()]
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids, n = [number[w] for w in words], len(number)
    windows = [(a * n + b) * n + c for a, b, c in zip(ids, ids[1:], ids[2:], strict=False)]
    repeated = 0
    if len(set(windows)) < len(windows):
        seen, twice = set(), set()
        for w in windows:
            (twice if w in seen else seen).add(w)
        at = [i for i, w in enumerate(windows) if w in twice]
        repeated = 3 + sum(min(3, b - a) for a, b in pairwise(at))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and COUNTS of each row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                cols = zip(*map(counts, part.column("text").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("host"), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "host", *COUNTS])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS))


def failed() -> Column:
    """The base rules: fewer than 50 words, or over half of the words in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def host_rates(rows: DataFrame) -> DataFrame:
    """host, n, failures and the shrunk failure rate.

    The prior is a beta distribution with the mean of all rows and, by moments, the spread of the hosts' rates about it (weighted by
    rows): its strength mean (1 - mean) / variance - 1 is kept within 1 and 1,000,000, so that one host or equal rates are defined.
    Hosts are counted before they are shuffled; the prior comes from sums over all hosts.
    """
    hosts = stage(rows.filter("host IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if("base_failed").alias("failures")), "hosts")
    spread = hosts.agg(F.sum("n").alias("all_n"), F.sum("failures").alias("all_f"), F.sum(F.col("failures") * F.col("failures") / F.col("n")).alias("sq"))
    prior = spread.select((F.col("all_f") / F.col("all_n")).alias("m"), (F.col("sq") / F.col("all_n")).alias("sq")).select("m", F.greatest(F.col("sq") - F.col("m") * F.col("m"), F.lit(1e-12)).alias("v"))
    strength = F.least(F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(1.0)), F.lit(1e6))
    return hosts.crossJoin(F.broadcast(prior.select("m", strength.alias("k")))).select("host", "n", "failures", ((F.col("failures") + F.col("m") * F.col("k")) / (F.col("n") + F.col("k"))).alias("rate"))  # the prior is one row


def host_rules(docs: DataFrame, threshold: float = 0.5, broadcast_rows: int = 100_000, salts: int = 32, **cols: str) -> DataFrame:
    """doc_id, host, COUNTS, base_failed and kept, one row for each row of docs.

    kept: the row passes the base rules and its host's shrunk failure rate is at most `threshold`. A row without a host is judged by
    its own rules alone. Null texts are empty and fail; equal rows count each; a null doc_id is carried along. Verdicts on hosts are
    broadcast up to `broadcast_rows` hosts and joined by host and salt beyond, so that a hot host is spread over `salts` tasks.
    """
    rows = stage(base_counts(docs, **cols).withColumn("base_failed", failed()), "counts")
    bad = stage(host_rates(rows).filter(F.col("rate") > threshold).select("host", F.lit(True).alias("bad")), "bad_hosts")
    fits, bad = small(bad, broadcast_rows)
    if fits:
        got = rows.join(bad, "host", "left")
    else:
        bad = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        got = rows.withColumn("salt", salt("doc_id", salts)).join(bad, ["host", "salt"], "left")
    return got.select("doc_id", "host", *COUNTS, "base_failed", (~F.col("base_failed") & F.col("bad").isNull()).alias("kept"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
p AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
base AS (
  SELECT doc_id, source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN p USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS failures FROM f WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT sum(failures) / sum(n) AS m, sum(failures * failures / n) / sum(n) AS sq FROM h),
q AS (SELECT m, least(greatest(m * (1 - m) / greatest(sq - m * m, 1e-12) - 1, 1.0), 1e6) AS k FROM s),
bad AS (SELECT source FROM h, q WHERE (failures + m * k) / (n + k) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept FROM f
"""
