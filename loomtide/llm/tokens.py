"""Token ids by a public tokenizer file, many texts at a time.

Exact for tokenizers whose patterns never join characters across ASCII white space (all word-splitting ones here): the ids of a text
are then the ids of its chunks, one after the other. Arrow finds the distinct chunks of about a megabyte of text; a memo, bounded in
bytes, holds the ids of those that came before, and the others are encoded. Tokenizers that put all in lower case share the ids of a
chunk's letters between its spellings.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import pairwise

import numpy as np

from .sets import LONG, SPACES, pieces, spaced, string_hashes, texts

#: Letters whose lower case is one letter, and ASCII punctuation without the apostrophe: a run of either is one word in any tokenizer here.
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() and b != 39 for b in range(256)])
#: Second bytes of the letters U+00C0 to U+00FF, whose first byte is 0xC3, and of the capital ones.
_SECOND = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])
_CAPITAL = np.array([0x80 <= b <= 0x9E and b != 0x97 for b in range(256)])


def pick(values: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists values[at[i]:at[i + 1]] for i in which, one after the other, and their offsets."""
    n = at[which + 1] - at[which]
    out_at = np.concatenate([[0], np.cumsum(n)])
    return values[np.repeat(at[which] - out_at[:-1], n) + np.arange(out_at[-1])], out_at


def strings(array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow binary array."""
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def binary(raw: np.ndarray, at: np.ndarray):
    """The Arrow binary array of raw[at[i]:at[i + 1]]."""
    import pyarrow as pa

    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def _array(words: list[str]):
    import pyarrow as pa

    return pa.array([w.encode() for w in words], pa.binary())


def _letters(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are of letters up to U+00FF, and which of these begin one of two bytes."""
    two = (raw == 0xC3) & _SECOND[np.append(raw[1:], 0)[: len(raw)].astype(np.uint8)]
    letter = _LETTER[raw] | two
    letter[1:] |= two[:-1]
    return letter, two


class Memo:
    """Lists of ids by byte string, in numpy arrays of at most `most` bytes and what one call adds. A string is found by a 64-bit hash and compared byte for byte."""

    def __init__(self, most: int = 48_000_000):
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.hash, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # in order of the hash
        self.raw, self.at = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.id_at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _found(self, raw: np.ndarray, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each string, and whether it is there."""
        if not len(self.hash):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        place = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        slot, size = self.slot[place], np.diff(at)
        same = (self.hash[place] == h) & (self.at[slot + 1] - self.at[slot] == size)
        rows = np.flatnonzero(same)
        mine, mine_at = pick(raw, at, rows)
        other = pick(self.raw, self.at, slot[rows])[0]
        if (differ := np.flatnonzero(mine != other)).size:
            same[rows[np.searchsorted(mine_at, differ, side="right") - 1]] = False
        return slot, same

    def slots(self, keys, make: Callable) -> np.ndarray:
        """The slots of an Arrow array of distinct strings; make(keys) gives the ids of new ones and their offsets."""
        raw, at = strings(keys)
        h = string_hashes(raw, at)
        slot, same = self._found(raw, at, h)
        new = np.flatnonzero(~same)
        if not len(new):
            return slot
        if 48 * (len(self.slot) + len(new)) + len(self.raw) + 4 * len(self.ids) > self.most and len(self.slot):
            self._clear()
            return self.slots(keys, make)
        ids, id_at = make(keys.take(new))
        slot[new] = len(self.slot) + np.arange(len(new))
        more, more_at = pick(raw, at, new)
        self.raw, self.at = np.concatenate([self.raw, more]), np.concatenate([self.at, self.at[-1] + more_at[1:]])
        self.ids, self.id_at = np.concatenate([self.ids, ids]), np.concatenate([self.id_at, self.id_at[-1] + id_at[1:]])
        new = new[np.argsort(h[new])]
        place = np.searchsorted(self.hash, h[new])
        self.hash, self.slot = np.insert(self.hash, place, h[new]), np.insert(self.slot, place, slot[new])
        return slot


class Merges:
    """The merges of a byte-level BPE model with a mark of word ends, for many words side by side."""

    def __init__(self, model: dict):
        vocab, end, plain = model["vocab"], model["end_of_word_suffix"], [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}  # of byte-level models
        self.inner, self.last = (np.array([vocab[letters[b] + x] for b in range(256)]) for x in ("", end))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.n, self.into = len(vocab), np.array([vocab[x + y] for x, y in pairs])
        key = np.array([vocab[x] * self.n + vocab[y] for x, y in pairs])
        self.rank = np.argsort(key)
        self.key = key[self.rank]

    def _ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x * self.n + y
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], len(self.key))

    def __call__(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the words raw[at[i]:at[i + 1]], none empty, and their offsets. A step merges in each word its first pair of the least rank."""
        none, n = len(self.key), len(at) - 1
        ids, word = self.inner[raw], np.repeat(np.arange(n), np.diff(at))
        ids[at[1:] - 1] = self.last[raw[at[1:] - 1]]
        rank, done = np.full(len(ids), none), []
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self._ranks(ids[inside], ids[inside + 1])
        while len(ids):
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.append(start, len(ids))))
            if (ready := best == none).any():
                done.append((word[ready], ids[ready]))
                ids, word, rank, best = (x[~ready] for x in (ids, word, rank, best))
            at_best = np.flatnonzero(rank == best)
            p = at_best[np.concatenate([[True], word[at_best[1:]] != word[at_best[:-1]]])[: len(at_best)]]
            ids[p] = self.into[rank[p]]
            keep = np.ones(len(ids), bool)
            keep[p + 1] = False
            ids, word, rank, p = ids[keep], word[keep], rank[keep], p - np.arange(len(p))
            for q in (p, p[p > 0] - 1):
                rank[q] = none
                q = q[q + 1 < len(ids)]
                q = q[word[q] == word[q + 1]]
                rank[q] = self._ranks(ids[q], ids[q + 1])
        word, ids = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 2
        order = np.argsort(word, kind="stable")
        return ids[order].astype(np.uint32), np.searchsorted(word[order], np.arange(n + 1))


class ChunkIds:
    """most: bytes of the memo. longest: of a word that is merged here; longer ones are left to the library."""

    def __init__(self, path: str, most: int = 64_000_000, longest: int = 64):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.memo, self.longest = Tokenizer.from_file(path), Memo(most), longest
        self.folds, self.merges = self._alone(["Aé,"])[0] == sum(self._alone(["aé", ","]), []), None
        trial = ["a", "thing", "aé", ",", "...", "übergröße", "aaaaaaa"]
        with contextlib.suppress(KeyError, TypeError):  # another kind of model: all is left to the library
            merges = self.folds and Merges(json.loads(self.tokenizer.to_str())["model"])
            got, at = merges(*strings(_array(trial)))
            if [got[i:j].tolist() for i, j in pairwise(at)] == self._alone(trial):
                self.merges = merges

    def _alone(self, words: list[str]) -> list[list[int]]:
        return [e.ids for i in range(0, len(words), 20_000) for e in self.tokenizer.encode_batch_fast(words[i : i + 20_000], add_special_tokens=False)]

    def _new(self, keys) -> tuple[np.ndarray, np.ndarray]:
        """ids of new strings and their offsets."""
        import pyarrow as pa

        raw, at = strings(keys)
        plain = np.zeros(len(keys), bool)
        if self.merges:
            letter, mark, size = *(np.add.reduceat(np.append(x, 0), at[:-1]) for x in (_letters(raw)[0], _MARK[raw])), np.diff(at)
            plain = ((letter == size) | (mark == size)) & (size > 0) & (size <= self.longest)
        beside = np.flatnonzero(plain)
        some, some_at = self.merges(*pick(raw, at, beside)) if len(beside) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        other = self._alone([w.decode() for w in keys.filter(pa.array(~plain)).to_pylist()])
        ids = np.concatenate([some, np.array([x for e in other for x in e], np.uint32)])
        id_at = np.concatenate([some_at, some_at[-1] + np.cumsum([len(x) for x in other])]).astype(np.int64)
        where = np.empty(len(keys), np.int64)
        where[np.concatenate([beside, np.flatnonzero(~plain)])] = np.arange(len(keys))
        return pick(ids, id_at, where)

    def _parts(self, raw: np.ndarray, at: np.ndarray):
        """An Arrow array with two strings for each chunk: of letters and then punctuation, each of them, the letters in lower case; else the chunk and nothing."""
        letter, two = _letters(raw)
        letters, marks = (np.concatenate([[0], np.cumsum(x)]) for x in (letter, _MARK[raw]))
        n, size = letters[at[1:]] - letters[at[:-1]], np.diff(at)
        plain = (n > 0) & (n + marks[at[1:]] - marks[at[:-1]] == size) & (letters[at[:-1] + n] - letters[at[:-1]] == n)
        inside = np.repeat(plain, size)
        low = raw.copy()
        low[inside & (raw >= 65) & (raw <= 90)] += 32
        low[1:][(inside & two)[:-1] & _CAPITAL[raw[1:]]] += 32
        edges = np.empty(2 * len(n) + 1, np.int64)
        edges[::2], edges[1::2] = at, np.where(plain, at[:-1] + n, at[1:])
        return binary(low, edges)

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the texts raw[at[i]:at[i + 1]] (UTF-8), one after the other, and the texts' offsets in them."""
        if len(at) == 2 and len(raw) > 2 * LONG and len(cuts := pieces(raw)) > 2:
            got = np.concatenate([self.encode(raw[i:j], np.array([0, j - i]))[0] for i, j in pairwise(cuts)])
            return got, np.array([0, len(got)])
        raw, at = spaced(raw, at)
        space = SPACES[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        chunks = binary(raw[~space], np.concatenate([[0], np.cumsum(end - start)])).dictionary_encode()
        if self.folds:
            parts = self._parts(*strings(chunks.dictionary)).dictionary_encode()
            slots = self.memo.slots(parts.dictionary, self._new)[parts.indices.to_numpy()]
            ids, part_at = pick(self.memo.ids, self.memo.id_at, slots)
            id_at = part_at[::2]
        else:
            slots = self.memo.slots(chunks.dictionary, self._new)
            ids, id_at = pick(self.memo.ids, self.memo.id_at, slots)
        ids, id_at = pick(ids, id_at, chunks.indices.to_numpy())
        return ids, id_at[np.searchsorted(start, at)]

    def encode_list(self, given: list[str | None]) -> list[np.ndarray]:
        raw = [(t or "").encode() for t in given]
        ids, at = self.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
        return [ids[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@cache
def chunk_ids(path: str) -> ChunkIds:
    """One for a worker process: what a task has encoded serves the next."""
    return ChunkIds(path)


def each_encoded(batches: Iterable, ids_of: ChunkIds, end_id: int) -> Iterator[tuple]:
    """About a megabyte of the texts of Arrow batches at a time: the ids, each text with end_id after it, the texts' offsets in them, and the rows."""
    for b in batches:
        column = b.column("text")
        for i, n, raw, at in texts(column.fill_null("") if column.null_count else column):
            ids, id_at = ids_of.encode(raw, at)
            yield np.insert(ids, id_at[1:], np.uint32(end_id)), id_at + np.arange(n + 1), b.slice(i, n)
