"""Word shingles as sets of 64-bit hashes, and odd sketches that bound how far two sets are apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MIX1, MIX2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads close values (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX1
        x = (x ^ (x >> np.uint64(27))) * MIX2
        return x ^ (x >> np.uint64(31))


#: A random value for each byte, A-Z as a-z, and which bytes part words.
_RAW = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = _RAW.copy()
_LOWER[65:91] = _RAW[97:123]
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_P, _INVERSE = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Powers that are kept for the next texts; those of longer texts are made anew.
_KEPT = 1 << 21
#: Longer texts are taken in pieces of so many bytes.
LONG = 1 << 21


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _P and of its inverse modulo 2**64."""
    powers = list(_powers)
    while len(powers[0]) < n:
        m = len(powers[0])
        with np.errstate(over="ignore"):
            for i, base in enumerate((_P, _INVERSE)):
                powers[i] = np.concatenate([powers[i], powers[i] * np.uint64(pow(base, m, 1 << 64))])
        if len(powers[0]) <= _KEPT:
            _powers[:] = powers
    return powers[0][:n], powers[1][:n]


def string_hashes(raw: np.ndarray, at: np.ndarray, values: np.ndarray = _RAW) -> np.ndarray:
    """A 64-bit hash of each string raw[at[i]:at[i + 1]]: a polynomial of random values of the bytes, mixed with the length."""
    return _hashed(raw, at[:-1], at[1:], values)


def _hashed(raw: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray) -> np.ndarray:
    power, inverse = _power(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[raw] * power[: len(raw)])])
        return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * STEP)


def pieces(raw: np.ndarray) -> list[int]:
    """Offsets that cut a long text into pieces of LONG bytes, each up to the next space."""
    cuts = [0]
    while cuts[-1] + LONG < len(raw):
        at = cuts[-1] + LONG
        while at < len(raw) and not (found := SPACES[raw[at : at + LONG]]).any():
            at += LONG
        cuts.append(at + int(found.argmax()) if at < len(raw) else len(raw))
    return cuts if cuts[-1] == len(raw) else [*cuts, len(raw)]


def word_hashes(raw: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word [^\\x20\\x09-\\x0D]+ of bytes: a polynomial of random values of the bytes, mixed with the length."""
    if len(raw) > 2 * LONG and len(cuts := pieces(raw)) > 2:
        got = [[x + i if k < 2 else x for k, x in enumerate(word_hashes(raw[i:j], lower))] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return tuple(np.concatenate(x) for x in zip(*got, strict=True))
    space = SPACES[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    return start, end, _hashed(raw, start, end, _LOWER if lower else _RAW)


def texts(column, most: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Groups of an Arrow string column's rows with about `most` bytes of text, any row whole: first row, rows, bytes, offsets of the rows."""
    import pyarrow as pa

    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        j = min(j, len(column), i + 4096)
        yield i, j - i, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def spaced(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a space between them."""
    return (np.insert(raw, at[1:-1], 32), at + np.minimum(np.arange(len(at)), max(0, len(at) - 2))) if len(at) > 2 else (raw, at)


def words_of(raw: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, and the offset of each row in them. A word never crosses rows."""
    raw, at = spaced(raw, at)
    start, _, h = word_hashes(raw, lower)
    return h, np.searchsorted(start, at)


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each position on; none if there are fewer than k."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for i in range(1, k):
            out = out * np.uint64(BASE) + words[i : i + n]
    return mix(out)


def shingles(words: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct windows of k words of each row, sorted, and the rows' offsets in them; of 1 to k - 1 words, all are one window."""
    all_windows, out = windows(words, k), []
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if j - i >= k:
            h = np.sort(all_windows[i : j - k + 1])
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
        elif j > i:
            out.append(mix(windows(words[i:j], j - i) + np.uint64(j - i)))
        else:
            out.append(words[:0])
    return np.concatenate([words[:0], *out]), np.cumsum([0, *map(len, out)])


def sketch_bits(n: int) -> int:
    """Four to eight times n."""
    return max(64, 1 << (4 * n - 1).bit_length()) if n else 64


def odd_sketch(items: np.ndarray) -> bytes:
    """A bit for each residue of the items, set if an odd number of items has it. Sets that differ in d items differ in d bits at most."""
    b = sketch_bits(len(items))
    return np.packbits((np.bincount((items & np.uint64(b - 1)).astype(np.int64), minlength=b) & 1).astype(np.uint8)).tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    """Lower bound of the number of items in one set alone. A longer sketch is folded to the length of the shorter."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())
