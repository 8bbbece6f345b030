"""Packing as vector bin packing: tokens, segments and loss-bearing tokens are three dimensions with a limit each.

A partition packs its own rows in a stream: a piece goes to the open sequence with the largest dot product of the piece's needs and
the sequence's free room (both as shares of the limits) among those where it fits. If it fits nowhere and no further sequence may be
opened, the best one takes as much as it can hold and the rest goes on. Full sequences leave at once. A sequence that can take no
more segments or loss, and what is open at the end, is cut at a power of two, which needs no padding. Nothing is shuffled, memory is
bounded by `open_bins` sequences, and a lost task repacks its partition to the same pieces and sequence ids.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import tidy
from .tokens import chunk_ids, each_encoded

SCHEMA = "doc_id long, start long, length long, loss long, ids binary, doc_tokens long, sequence_id long, offset long"


class Limits(NamedTuple):
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


class Piece(NamedTuple):
    doc_id: int | None
    start: int
    ids: np.ndarray
    total: int
    unmasked: int  #: from this position of the document on, tokens bear loss

    @property
    def loss(self) -> int:
        return max(0, self.start + len(self.ids) - max(self.start, self.unmasked))

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[:n]), self._replace(start=self.start + n, ids=self.ids[n:])

    def fitting(self, tokens: int, loss: int) -> int:
        """Tokens from the front that need at most so much of both."""
        return min(len(self.ids), tokens, max(0, self.unmasked - self.start) + loss)


class Packer:
    def __init__(self, limits: Limits, open_bins: int, emit: Callable[[list[Piece]], None]):
        self.limits, self.emit, self.most = np.array(limits, float), emit, open_bins
        self.free = np.zeros((0, 3))
        self.bins: list[list[Piece]] = []

    def add(self, piece: Piece) -> None:
        todo = deque([piece])
        while todo:
            p = todo.popleft()
            t, _, most_loss = (int(x) for x in self.limits)
            while (n := p.fitting(t, most_loss)) == t and len(p.ids) >= t:
                head, p = p.cut(n)
                self.emit([head])
            if not len(p.ids):
                continue
            need = np.array([len(p.ids), 1, p.loss], float)
            score = (self.free / self.limits**2) @ need
            fits = (self.free >= need).all(1)
            if fits.any():
                at = int(np.where(fits, score, -1).argmax())
            elif len(self.bins) < self.most:
                self.bins.append([])
                self.free = np.vstack([self.free, self.limits])
                at = len(self.bins) - 1
            else:
                at = int(score.argmax())
            n = p.fitting(int(self.free[at, 0]), int(self.free[at, 2]))
            if n and self.free[at, 1] >= 1:
                head, rest = p.cut(n)
                self.bins[at].append(head._replace(ids=head.ids.copy()))  # not the megabyte that it is part of
                self.free[at] -= [n, 1, head.loss]
                if len(rest.ids):
                    todo.appendleft(rest)
            else:
                todo.appendleft(p)
                self.free[at, 1] = 0
            if self.free[at, 0] == 0:
                self.emit(self._drop(at))
            elif self.free[at, 1] < 1 or n < len(p.ids):
                todo.extend(self._closed(self._drop(at)))

    def _drop(self, at: int) -> list[Piece]:
        self.free = np.delete(self.free, at, 0)
        return self.bins.pop(at)

    def _closed(self, pieces: list[Piece]) -> list[Piece]:
        """Emit the largest power of two of their tokens; the rest is returned."""
        goal, out = 1 << sum(len(p.ids) for p in pieces).bit_length() - 1, []
        for i, p in enumerate(pieces):
            head, rest = p.cut(goal)
            out.append(head)
            goal -= len(head.ids)
            if not goal:
                self.emit(out)
                return [rest] * bool(len(rest.ids)) + pieces[i + 1 :]
        raise AssertionError

    def close(self) -> None:
        todo = deque(p for b in self.bins for p in b)
        self.bins, self.free = [], np.zeros((0, 3))
        while todo:
            room, seq = [int(x) for x in self.limits], []
            while todo and room[1]:
                if not (n := todo[0].fitting(room[0], room[2])):
                    break
                head, rest = todo.popleft().cut(n)
                seq.append(head)
                room = [room[0] - n, room[1] - 1, room[2] - head.loss]
                if len(rest.ids):
                    todo.appendleft(rest)
            todo.extendleft(reversed(self._closed(seq)))


def pack(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), open_bins: int = 64, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None) -> DataFrame:
    """The pieces (SCHEMA), ids as little-endian unsigned 32-bit integers.

    A document is its ids and then end_id. With prompt_col, the first so many tokens of a document bear no loss (null: none of them);
    otherwise all do. Null and empty texts are end_id alone. Equal rows are packed each; a null doc_id is carried along. An empty
    table gives no pieces. Other columns of docs are not read.
    """
    prompt = F.coalesce(F.col(prompt_col).cast("long"), F.lit(0)) if prompt_col else F.lit(0).cast("long")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        out: list[tuple] = []
        made, first = 0, TaskContext.get().partitionId() << 32
        names = ["doc_id", "start", "length", "loss", "ids", "doc_tokens", "sequence_id", "offset"]
        types = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 3

        def emit(seq: list[Piece]) -> None:
            nonlocal made
            at = 0
            for p in seq:
                out.append((p.doc_id, p.start, len(p.ids), p.loss, p.ids.tobytes(), p.total, first + made, at))
                at += len(p.ids)
            made += 1

        def batch():
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        packer = Packer(limits, open_bins, emit)
        for ids, at, rows in each_encoded(batches, chunk_ids(tokenizer), end_id):
            for doc_id, masked, i, j in zip(rows.column("doc_id").to_pylist(), rows.column("masked").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                packer.add(Piece(doc_id, 0, ids[i:j], j - i, min(max(0, masked), j - i)))
                if len(out) >= 2000:
                    yield batch()
        packer.close()
        if out:
            yield batch()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), prompt.alias("masked")).mapInArrow(tidy(run), SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
