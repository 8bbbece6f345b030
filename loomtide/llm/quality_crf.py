"""Quality by a linear-chain conditional random field over the lines of a document.

Every line is good or bad; its features are its own and its neighbours'. The chain is trained on lines that carry their document's
label. Forward-backward gives each line's marginal of being good; their mean, weighted by length, is set on the scale of the labels by
a logistic curve with two parameters, fitted on the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stage, tidy

SYMBOLS, DIGITS = "#*$%&|<>", "0123456789"


class Model(NamedTuple):
    weights: np.ndarray  #: of the features of this line, the one before and the one after, for good against bad
    switch: np.ndarray  #: 2 x 2, potentials of neighbouring labels
    mean: np.ndarray
    scale: np.ndarray
    curve: tuple[float, float]


def line_features(lines: list[str]) -> np.ndarray:
    """One row for each line: counts as shares of its characters or words, its size, and whether it came before."""
    out, seen = np.zeros((len(lines), 13), np.float32), set()
    for i, x in enumerate(lines):
        words = x.split()
        k = len(words)
        if not k:
            continue
        letters = sum(map(len, words)) or 1
        again = sum(map(eq, words, words[1:]))
        uniq = len(set(words))
        out[i] = (1, math.log1p(k), letters / k / 10, sum(map(str.isupper, words)) / k, x.count("!") / k, sum(map(x.count, SYMBOLS)) / k, x.count("|") / k, again / k, 1 - uniq / k, sum(map(x.count, DIGITS)) / letters, x in seen, (x.count(".") + x.count(",")) / k, k < 4)
        seen.add(x)
    return out


def around(own: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Own features and those of the lines before and after within a document."""
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[starts] = 0
    after[starts - 1] = 0  # of the last lines; index -1 is the last line of all
    return np.hstack([own, before, after])


def marginals(scores: np.ndarray, sizes: np.ndarray, switch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected counts of neighbouring labels; scores: good against bad, documents one after the other.

    Chains run side by side, longest first, one step of numpy for each position.
    """
    total, pairs = len(scores), np.zeros((2, 2))
    if not total:
        return np.zeros(0), pairs
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    live = [int(x) for x in np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")]
    own = np.exp(np.stack([np.zeros(total), np.clip(scores, -30, 30)], 1))
    own /= own.sum(1, keepdims=True)
    move = np.exp(switch)
    ahead, back = np.empty((total, 2)), np.ones((total, 2))
    for t, n in enumerate(live):
        at = starts[:n] + t
        a = own[at] * (ahead[at - 1] @ move if t else 1)
        ahead[at] = a / a.sum(1, keepdims=True)
    for t in range(len(live) - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        b = (own[at + 1] * back[at + 1]) @ move.T
        back[at] = b / b.sum(1, keepdims=True)
        joint = ahead[at][:, :, None] * move * (own[at + 1] * back[at + 1])[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    both = ahead * back
    return both[:, 1] / both.sum(1), pairs


def chains(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with a word, lines of each document, and the lines' lengths. A text without words is one empty line."""
    lines = [[x for x in t.split("\n") if x.strip()] or [""] for t in texts]
    sizes = np.array([len(x) for x in lines])
    own = np.vstack([line_features(x) for x in lines])
    return around(own, np.r_[0, np.cumsum(sizes)[:-1]]), sizes, np.array([max(1, len(x)) for d in lines for x in d], float)


def weighted(good: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    return np.add.reduceat(good * lengths, starts) / np.add.reduceat(lengths, starts)


def fit(texts: list[str], labels: list[int], rounds: int = 60, longest: int = 64, rate: float = 0.3, decay: float = 1e-3) -> Model:
    """Gradient ascent with momentum on the chains' likelihood, classes weighted alike; chains are cut at `longest` lines for it."""
    x, sizes, lengths = chains(texts)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    z[:, 0] = 1  # the constant
    y = np.asarray(labels, float)
    line_y = np.repeat(y, sizes)
    cut = np.concatenate([[longest] * (n // longest) + [n % longest] * bool(n % longest) for n in sizes.tolist()]).astype(int)
    starts = np.r_[0, np.cumsum(cut)[:-1]]
    share = y.mean()
    row = np.where(line_y > 0, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)) / np.repeat(sizes, sizes) / len(sizes)
    w, switch, dw, ds = np.zeros(z.shape[1]), np.zeros((2, 2)), 0.0, 0.0
    first = line_y[starts].astype(int)
    seen = np.zeros((2, 2))
    np.add.at(seen, (first, first), cut - 1)
    for _ in range(rounds):
        good, pairs = marginals(z @ w, cut, switch)
        dw = 0.9 * dw + z.T @ ((line_y - good) * row) - decay * w
        ds = 0.9 * ds + (seen - pairs) / max(1, seen.sum()) - decay * switch
        w, switch = w + rate * dw, np.clip(switch + rate * ds, -2, 2)
    model = Model(w, switch, mean, scale, (1.0, 0.0))
    raw = weighted(marginals(z @ w, sizes, switch)[0], sizes, lengths)
    a, b = 4.0, -2.0
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-(a * raw + b)))
        g = np.array([((y - p) * raw).sum() - 0.01 * a, (y - p).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * raw * raw).sum() + 0.01, (v * raw).sum()], [(v * raw).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
    return model._replace(curve=(max(a, 1e-3), b))


def scores(model: Model, texts: list[str]) -> np.ndarray:
    x, sizes, lengths = chains(texts)
    z = (x - model.mean) / model.scale
    z[:, 0] = 1
    raw = weighted(marginals(z @ model.weights, sizes, model.switch)[0], sizes, lengths)
    return 1 / (1 + np.exp(-(model.curve[0] * raw + model.curve[1])))


def held_out(col: str = "doc_id"):
    return F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, most: int = 3000, longest_text: int = 200_000, most_bytes: int = 64_000_000) -> Model:
    """A model from a bounded sample: `most` labelled ids that are not held out, texts of at most `longest_text` bytes, `most_bytes` in all.

    The sample is by a hash of doc_id, so it is the same on every run. Labels other than 0 and 1 are not used; of repeated labels the
    smallest counts, and of a repeated doc_id its least text. Without labelled rows of both kinds, all lines count as good (score 0.5
    and above nowhere trained).
    """
    order = F.xxhash64("doc_id")
    picked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & ~held_out())
              .groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(order, "doc_id").limit(most))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= longest_text)
    sample = stage(texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")), "labelled")  # at most `most` rows
    sizes, ids = sample.select("doc_id", F.octet_length("text").alias("n"), order.alias("h")).orderBy("h", "doc_id").collect(), []
    for r in sizes:
        if (most_bytes := most_bytes - r.n) < 0:
            break
        ids.append(r.doc_id)
    rows = sorted(sample.filter(F.col("doc_id").isin(ids)).collect() if ids else [])
    y = [r.quality for r in rows]
    if len(set(y)) < 2:
        return Model(np.zeros(39), np.zeros((2, 2)), np.zeros(39), np.ones(39), (1.0, 0.5))
    return fit([r.text for r in rows], y)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column `name`, 0 to 1: P(high quality). Reads the text alone; null is empty. All rows and other columns stay as they are; a column `name` is replaced."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([f for f in docs.schema.fields if f.name != name] + [StructField(name, DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            b = b.select([c for c in b.schema.names if c != name])
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                got = scores(model, [t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())], [*part.schema.names, name])

    return docs.mapInArrow(tidy(run), schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs; null and empty texts are scored as one empty line, equal rows alike.

    A null doc_id is carried along, and not held out. An empty table gives an empty result. Other columns of docs are not read.
    """
    model = train(docs, labels)
    rows = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
