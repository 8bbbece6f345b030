"""SentencePiece encoding and decoding from a model file: an Aho-Corasick automaton over the pieces and one pass over the text.

The automaton reports, at each position, all pieces that end there (it follows the output links). For a unigram model each one relaxes
the best score of its end: a single-pass Viterbi. A model of kind BPE has ranks for scores, and the path with the best sum of ranks is
not what its merges give; there, the same pass keeps at each position the one piece that can follow the piece kept at its start, that
is, whose pair the merges leave as it is. By induction the kept pieces are the merges' result for every prefix. Characters without a
piece are a piece of their own and become their UTF-8 bytes, if the model has byte pieces, or <unk>.

A piece never crosses the start of a run of spaces, so texts are encoded in units of a run of spaces and what follows it. Arrow finds the
distinct units of about a megabyte of text; those that came before are in a memo of a worker, bounded in bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import tidy
from .sets import texts
from .tokens import Memo, binary, pick

SPACE = "▁"
UNIGRAM, BPE = 1, 2
#: What an unknown character costs below the least score of a unigram model.
UNKNOWN_PENALTY = 10.0


class Pieces:
    """capacity: units, and a quarter of the pairs of pieces, that are remembered one by one; most: bytes of the memo of units."""

    def __init__(self, path: str, capacity: int = 150_000, most: int = 64_000_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self._load(model, capacity, most)

    def _load(self, model, capacity: int, most: int = 64_000_000) -> None:
        import ahocorasick

        if model.trainer_spec.model_type not in (UNIGRAM, BPE) or model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only unigram and BPE models that leave characters as they are")
        self.kind, self.prefix, self.capacity = model.trainer_spec.model_type, model.normalizer_spec.add_dummy_prefix, capacity
        self.names = [p.piece for p in model.pieces]
        usable = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type in (1, 4)}  # normal and user-defined
        self.ids, self.scores = {p: i for p, (i, _) in usable.items()}, {p: s for p, (_, s) in usable.items()}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.control = {i for i, p in enumerate(model.pieces) if p.type == 3}
        self.least = min(self.scores.values()) - UNKNOWN_PENALTY
        self.single, self.name_of, self.pair_ids = {p for p in usable if len(p) == 1}, {i: p for p, i in self.ids.items()}, {}
        self.plain = [b"" if i in self.control else " ⁇ ".encode() if i == self.unknown else bytes([self.byte_of[i]]) if i in self.byte_of else p.encode() for i, p in enumerate(self.names)]
        self.automaton = ahocorasick.Automaton()
        for p in usable:
            self.automaton.add_word(p, (len(p), self.ids[p]))
        self.automaton.make_automaton()
        whole = any(SPACE in p.lstrip(SPACE) for p in usable)
        apart = "" if any("\n" in p for p in usable) else "\n"
        self.units = re.compile(r"[\s\S]+" if whole else f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+|{apart or SPACE}+")
        self.simple, self.units_seen = not whole and apart == "\n", Memo(most)
        self.plain_raw = np.frombuffer(b"".join(self.plain), np.uint8)
        self.plain_at = np.concatenate([[0], np.cumsum([len(x) for x in self.plain])]).astype(np.int64)
        self.memo: dict[str, bytes] = {}
        self.other: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The merges' result for a short text, merge by merge."""
        parts, get = list(text), self.scores.get
        scores = [get(x + y, -np.inf) for x, y in pairwise(parts)]
        while scores and (best := max(scores)) > -np.inf:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], -np.inf)
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], -np.inf)
        return parts

    def follows(self, before: str, piece: str) -> bool:
        """Whether the merges leave `piece` after `before`; before is empty at the start."""
        if (known := self.pairs.get((before, piece))) is None:
            if len(self.pairs) > 4 * self.capacity:
                self.pairs.clear()
            known = self.pairs[before, piece] = self.merged(before + piece) == [x for x in (before, piece) if x]
        return known

    def split(self, unit: str) -> list[str]:
        n, at = len(unit), 0
        kept: list[str | None] = [None] * (n + 1)
        best = [0.0] + [-np.inf] * n
        kept[0] = ""

        def single(i: int) -> None:  # the edge of a character without a piece
            if unit[i] not in self.scores and kept[i] is not None and (self.kind == BPE or best[i] + self.least > best[i + 1]):
                kept[i + 1], best[i + 1] = unit[i], best[i] + self.least

        for end, (size, number) in self.automaton.iter(unit):
            while at <= end:
                single(at)
                at += 1
            j, i, piece = end + 1, end + 1 - size, self.name_of[number]
            if kept[i] is None:
                continue
            if self.kind == UNIGRAM:
                if (s := best[i] + self.scores[piece]) > best[j]:
                    best[j], kept[j] = s, piece
            elif self.follows(kept[i], piece):
                kept[j] = piece
        while at < n:
            single(at)
            at += 1
        out, j = [], n
        while j:
            out.append(kept[j])
            j -= len(kept[j])
        return out[::-1]

    def chained(self, unit: str) -> list[int]:
        """split() by ids, for a BPE model and a unit of characters that are pieces all: one of the pieces that end at a position is right."""
        kept: list[int | None] = [-1] + [None] * len(unit)
        pairs, n_pieces, starts = self.pair_ids, len(self.names), [0] * (len(unit) + 1)
        for end, (size, number) in self.automaton.iter(unit):
            if kept[end + 1] is None and (before := kept[end + 1 - size]) is not None:
                key = before * n_pieces + number
                if (known := pairs.get(key)) is None:
                    if len(pairs) > 4 * self.capacity:
                        pairs.clear()
                    known = pairs[key] = self.merged(self.name_of.get(before, "") + self.name_of[number]) == [self.name_of[x] for x in (before, number) if x >= 0]
                if known:
                    kept[end + 1], starts[end + 1] = number, end + 1 - size
        out, j = [], len(unit)
        while j:
            out.append(kept[j])
            j = starts[j]
        return out[::-1]

    def ids_of(self, unit: str) -> bytes:
        if self.kind == BPE and self.single.issuperset(unit):
            return np.array(self.chained(unit), "<u4").tobytes()
        out: list[int] = []
        for p in self.split(unit):
            if p in self.ids:
                out.append(self.ids[p])
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return np.array(out, "<u4").tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if self.prefix and SPACE not in text and "" not in (words := text.split(" ")):
            units, make = words, self._word  # single spaces: each word begins with one
        else:
            units, make = self.units.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE)), self.ids_of
        memo = self.memo if make == self._word else self.other
        new = set(units).difference(memo)
        if len(memo) + len(new) > self.capacity:
            memo.clear()
            new = set(units)
        for u in new:
            memo[u] = make(u)
        ids = np.frombuffer(b"".join(map(memo.__getitem__, units)), "<u4")
        for u in new:
            if len(u) > 64:
                del memo[u]
        return ids

    def _word(self, word: str) -> bytes:
        return b"".join(map(self.ids_of, self.units.findall(SPACE + word)))

    def _new(self, keys) -> tuple[np.ndarray, np.ndarray]:
        got = [self.ids_of(k.decode().replace(" ", SPACE)) for k in keys.to_pylist()]
        return np.frombuffer(b"".join(got), "<u4"), np.concatenate([[0], np.cumsum([len(x) // 4 for x in got])]).astype(np.int64)

    def encode_rows(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the texts raw[at[i]:at[i + 1]] (UTF-8), one after the other, and the texts' offsets in them."""
        data = raw.tobytes()
        if not self.simple or SPACE.encode() in data:
            got = [self.encode(data[i:j].decode()) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            return np.concatenate([np.zeros(0, np.uint32), *got]), np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64)
        filled = np.diff(at) > 0
        if self.prefix:
            raw, at = np.insert(raw, at[:-1][filled], 32), at + np.concatenate([[0], np.cumsum(filled)])
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        space, line = raw == 32, raw == 10
        first = np.ones(len(raw), bool)  # of a unit: a run of spaces and what follows it, or a run of line ends
        first[1:] = (space[1:] & ~space[:-1]) | (line[1:] & ~line[:-1]) | (~space[1:] & ~line[1:] & line[:-1])
        first[at[:-1][filled]] = True
        start = np.flatnonzero(first)
        units = binary(raw, np.append(start, len(raw))).dictionary_encode()
        slots = self.units_seen.slots(units.dictionary, self._new)[units.indices.to_numpy()]
        ids, id_at = pick(self.units_seen.ids, self.units_seen.id_at, slots)
        return ids, id_at[np.searchsorted(start, at)]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_rows(ids, np.array([0, len(ids)]))[0]

    def decode_rows(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        raw, raw_at = pick(self.plain_raw, self.plain_at, ids.astype(np.int64))
        data, edges = raw.tobytes(), raw_at[at].tolist()
        texts = [data[i:j].decode(errors="replace").replace(SPACE, " ") for i, j in pairwise(edges)]
        return [t[1:] if self.prefix and t.startswith(" ") else t for t in texts]


@cache
def pieces_of(path: str) -> Pieces:
    """One for a worker process: what a task has encoded serves the next."""
    return Pieces(path)


def _schema(df: DataFrame, name: str, kind: str) -> tuple[list[str], str]:
    from pyspark.sql.types import BinaryType, StringType, StructField, StructType

    keep = [c for c in df.columns if c != name]
    return keep, StructType([df.schema[c] for c in keep] + [StructField(name, BinaryType() if kind == "binary" else StringType())])


def encode(df: DataFrame, path: str, text_col: str = "text", name: str = "ids") -> DataFrame:
    """df with a column of piece ids as little-endian unsigned 32-bit integers; null and empty texts have none. Any length; equal rows alike.

    A column `name` is replaced; all others stay. An empty table gives an empty one.
    """
    keep, schema = _schema(df, name, "binary")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pieces = pieces_of(path)
        for b in batches:
            column = b.column("#in")
            for i, n, raw, at in texts(column.fill_null("") if column.null_count else column):
                ids, id_at = pieces.encode_rows(raw, at)
                got = binary(np.ascontiguousarray(ids, "<u4").view(np.uint8), 4 * id_at)
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, n) for c in keep), got], [*keep, name])

    return df.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).alias("#in")).mapInArrow(tidy(run), schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """df with the text of a column of ids; null is empty. A text comes back as it was, but U+2581 as a space. A column `name` is replaced."""
    keep, schema = _schema(df, name, "string")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pieces = pieces_of(path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                given = [x or b"" for x in part.column("#in").to_pylist()]
                at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in given])]).astype(np.int64)
                got = pieces.decode_rows(np.frombuffer(b"".join(given), "<u4"), at)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(got, pa.string())], [*keep, name])

    return df.select(*(F.col(f"`{c}`") for c in keep), F.col(ids_col).alias("#in")).mapInArrow(tidy(run), schema)
