"""Similarity join of word-shingle sets by PartEnum signatures.

Sets whose Jaccard similarity reaches the threshold differ in few items for their size. Sizes fall into bands, each as wide as the
threshold allows partners to be, so that partners are in one band or in neighbours; every set is signed for its own band and the next.
In a band, sets of at most `top` items differ in at most k = 2 top (1 - t) / (1 + t) items. The domain of all items is cut by a hash
into n1 first-level partitions, each of these into N2 second-level ones, and for every first-level partition the subsets of its
second-level partitions are enumerated that leave SKIP of them out. At most k / (SKIP + 1) first-level partitions hold more than SKIP
differing second-level ones, so with (k + 1) / (SKIP + 1) of them, rounded up, partners agree on a subset of at least one. A signature
is the hash of the set's items in a subset.

A subset that is empty in a set says nothing and isn't signed. n1 is raised by `spare` first-level partitions for it: then partners agree
in more than `spare` of them, and a set with at most `spare` that have an empty subset shares a subset with items with each partner.
Two sets that have more of them are signed again with another hash, and so on; after ROUNDS hashes, the empty subsets are signed too.

Equal sets are made one class first. Classes that share a signature are candidates. A group of them is compared with its leader, not pair
by pair: members that are linked to the leader need no comparison with each other, and one that is far from the leader (over twice the
threshold's distance) can be linked with none of those, since the Jaccard distance is a metric. The few members that this leaves open are
compared where they lie, block by block, by odd sketches, which bound the distance from below; pairs of different components that
may be linked come out, first each member with the one that seems nearest, and, once that joins no further components, all that are
left. Open groups over `split_over` members, most of them of one component, are cut: each part has some of its members and all the others.
The members of groups with more others are signed anew with independent hashes, each once: partners share one of these signatures as well.
Open members are compared in turns, so that few copies of a sketch are on disk, and so are pairs, for the copies of whole sets.
Candidates are then held against each other's whole sets. So all links between different sets are found or implied.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import row_ids, salt, small, stage, tidy, unstage
from ..operators.components import components
from .sets import STEP, bits_apart, mix, odd_sketch, shingles, texts, words_of


def bands(percent: int, most: int) -> list[tuple[int, int]]:
    """(smallest, largest) sizes of each band up to one that holds `most`: 100 * smallest >= percent * largest."""
    out, low = [], 1
    while not out or out[-1][1] < most:
        out.append((low, low * 100 // percent))
        low = out[-1][1] + 1
    return out


@cache
def _bands(percent: int, power: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    got = bands(percent, 1 << power)
    return np.array([b[1] for b in got]), got


N2, SKIP, ROUNDS, NEAREST_ROUNDS, SPLITS = 2, 1, 8, 3, 3
#: Copies of sketches, for each of all sets, that are dealt at once; DEALT_ROWS in any case.
DEALT, DEALT_ROWS = 4, 1_000_000
#: Pairs whose whole sets are dealt at once, as a share of all sets; PAIRS_ROWS in any case.
PAIRS, PAIRS_ROWS = 6, 20_000
#: Bytes of a signature that are dealt, beside the number of its part; signatures in a part, about.
SIG, PART = 5, 1_000_000
#: Links that the driver may follow.
FINISH = 250_000
SUBSETS = list(combinations(range(N2), N2 - SKIP))


@cache
def shape(top: int, percent: int) -> tuple[int, int]:
    """n1 and `spare` of a band: about as many as the first-level partitions with an empty subset in a set of 0.68 top items, the usual case of the next smaller band. 0 where k is 0."""
    k = 2 * top * (100 - percent) // (100 + percent)
    if not k:
        return 0, 0
    need, spare = -(-(k + 1) // (SKIP + 1)), 0
    while True:
        n1 = need + spare
        empty = math.exp(-0.68 * top * (N2 - SKIP) / N2 / n1)
        mean = n1 * (1 - (1 - empty) ** len(SUBSETS))
        if spare >= mean + math.sqrt(mean) or spare > 2 * need:
            return n1, spare
        spare += 1


def signatures(items: np.ndarray, at: np.ndarray, percent: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of the sets items[at[i]:at[i + 1]] (sorted distinct hashes), each for its own band and the next."""
    sizes = np.diff(at)
    tops, all_bands = _bands(percent, max(10, int(sizes.max(initial=0)).bit_length() + 1))
    band, rows, sigs = np.searchsorted(tops, sizes), [], []
    for next_band in (0, 1):
        todo = np.flatnonzero(sizes > 0)
        n1_of, spare_of = np.array([shape(b[1], percent) for b in all_bands]).T
        todo = todo[n1_of[band[todo] + next_band] > 0]
        for again in range(ROUNDS):
            if not len(todo):
                break
            j, n = band[todo] + next_band, sizes[todo]
            n1 = n1_of[j]
            first = np.concatenate([[0], np.cumsum(n1 * N2)])
            of = np.repeat(np.arange(len(todo)), n)
            mine = items[np.arange(len(of)) + np.repeat(at[todo] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)]
            with np.errstate(over="ignore"):
                name = mix(j.astype(np.uint64) * STEP + np.uint64(again + (seed << 8)))
                mixed = mix(mine ^ name[of])
                cell = first[of] + ((mixed >> np.uint64(32)) * (n1 * N2).astype(np.uint64)[of] >> np.uint64(32)).astype(np.int64)
                mixed = mix(mixed)
                low, high = (np.bincount(cell, part.astype(np.float64), first[-1]).astype(np.uint64) for part in (mixed & np.uint64(0xFFFFFFFF), mixed >> np.uint64(32)))
                held, count = mix(low + high * STEP).reshape(-1, N2), np.bincount(cell, minlength=first[-1]).reshape(-1, N2)
                part_of, part = np.repeat(np.arange(len(todo)), n1), np.arange(len(held)) - np.repeat(first[:-1] // N2, n1)
                found, nothing = [], np.zeros(len(held), bool)
                for s, kept in enumerate(SUBSETS):
                    sig = mix((held[:, kept] * np.array([2 * c + 1 for c in kept], np.uint64)).sum(1) ^ mix(name[part_of] + (part * len(SUBSETS) + s).astype(np.uint64)))
                    empty = (count[:, kept] == 0).all(1)
                    nothing |= empty
                    found.append((sig, empty))
            short = np.bincount(part_of[nothing], minlength=len(todo)) > spare_of[j]
            last = again == ROUNDS - 1
            for sig, empty in found:
                keep = ~empty | (short[part_of] if last else False)
                rows.append(todo[part_of[keep]])
                sigs.append(sig[keep])
            todo = todo[short]
    return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.uint64), *sigs])


def each_sets(batches, k: int):
    """(doc_ids, items, offsets) of the rows of Arrow batches (doc_id, text), a megabyte of text at a time."""
    for b in batches:
        ids, column = b.column("doc_id"), b.column("text")
        for i, n, raw, at in texts(column.fill_null("") if column.null_count else column):
            yield ids.slice(i, n), *shingles(*words_of(raw, at), k)


def rows_of(cols: dict, types: dict) -> Iterator:
    """Arrow batches of at most 64k rows from columns of the same length."""
    import pyarrow as pa

    n = len(next(iter(cols.values())))
    for i in range(0, n, 65_536):
        yield pa.RecordBatch.from_arrays([pa.array(v[i : i + 65_536], types[c]) for c, v in cols.items()], list(cols))


def describe(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, given (an id that is carried along), n_shingles, key (equal for equal sets) and sketch of each row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            done = 0
            for ids, items, at in each_sets([b], k):
                got = [items[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                keys, sketches = [xxhash.xxh3_128_digest(x.tobytes()) for x in got], map(odd_sketch, got)
                yield pa.RecordBatch.from_arrays([ids, b.column("given").slice(done, len(ids)), pa.array(np.diff(at), pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "given", "n_shingles", "key", "sketch"])
                done += len(ids)

    return docs.select("doc_id", F.col("given").cast("long").alias("given"), "text").mapInArrow(tidy(run), "doc_id long, given long, n_shingles long, key binary, sketch binary")


def pack(sig: np.ndarray, rep: np.ndarray, parts: int):
    """An Arrow batch of signatures and their sets, a row for each part that has any: part, base, sigs (SIG bytes each), reps (what each rep, in order, is over base, all in as many bytes as the largest needs)."""
    import pyarrow as pa

    part = ((sig >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    order = np.lexsort((rep, part))
    part, base = part[order], rep.min()
    over = rep[order].view(np.uint64) - base.view(np.uint64)
    wide = max(1, -(-int(over.max()).bit_length() // 8))
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    ends = np.append(first, len(sig))

    def column(values: np.ndarray, size: int):
        raw = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size])
        return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * size).astype(np.int32)), pa.py_buffer(raw)])

    return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), pa.array(np.full(len(first), base)), column(sig[order], SIG), column(over, wide)], ["part", "base", "sigs", "reps"])


def unpack(part: int, base: int, sigs: bytes, reps: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, reps) of a row of pack(): part and the SIG bytes as one number; two signatures that agree in it make a group too large, no harm."""
    n = len(sigs) // SIG

    def number(raw: bytes) -> np.ndarray:
        out = np.zeros((n, 8), np.uint8)
        out[:, : len(raw) // n] = np.frombuffer(raw, np.uint8).reshape(n, -1)
        return out.view("<u8")[:, 0]

    with np.errstate(over="ignore"):
        return number(sigs) | np.uint64(part << 8 * SIG), (number(reps) + np.int64(base).view(np.uint64)).view(np.int64)


def signed(docs: DataFrame, k: int, percent: int, seed: int = 0, parts: int = 0) -> DataFrame:
    """(sig, rep): a row for each signature of each row of docs (doc_id not null, text); with `parts`, packed for so many tasks: about 7 bytes each in a shuffle, where such a row takes 12."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for ids, items, at in each_sets(batches, k):
            row, sig = signatures(items, at, percent, seed)
            rep = ids.to_numpy(zero_copy_only=False)[row]
            if not parts:
                yield from rows_of({"sig": sig.view(np.int64), "rep": rep}, {"sig": pa.int64(), "rep": pa.int64()})
            elif len(sig):
                yield pack(sig, rep, parts)

    return docs.mapInArrow(tidy(run), "part int, base long, sigs binary, reps binary" if parts else "sig long, rep long")


def grouped(packed: DataFrame, parts: int, seed: int = 0) -> DataFrame:
    """(sig, rep, leader) of the groups with two members at least; a leader is its group's least rep. A task holds a part, of about PART signatures."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        got = [unpack(*row) for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if not got:
            return
        sig, rep = (np.concatenate(x) for x in zip(*got, strict=True))
        got.clear()
        order = np.argsort(sig)
        sig, rep = sig[order], rep[order]
        same = sig[1:] == sig[:-1]
        many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        sig, rep = sig[many], rep[many]
        if not len(sig):
            return
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        leader = np.repeat(np.minimum.reduceat(rep, first), np.diff(np.append(first, len(sig))))
        order = np.lexsort((rep, sig, leader))  # a leader's groups lie together and take fewer bytes
        sig = mix(sig ^ mix(np.uint64(seed)))
        yield from rows_of({"sig": sig[order].view(np.int64), "rep": rep[order], "leader": leader[order]}, {c: pa.int64() for c in ("sig", "rep", "leader")})

    return packed.repartitionById(parts, "part").mapInArrow(tidy(run), "sig long, rep long, leader long")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(rep, items): the sorted hashes as bytes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for ids, items, at in each_sets(batches, k):
            yield pa.RecordBatch.from_arrays([ids, pa.array([items[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], ["rep", "items"])

    return docs.mapInArrow(tidy(run), "rep long, items binary")


def compared(rows: DataFrame, percent: int, nearest: bool, block: int = 512) -> DataFrame:
    """(sig, a, b): pairs of a group (sig) of different components that their sketches allow to be linked, a < b; nearest: each member a that has any, once, with the b least apart.

    A member that has no pair here has none later either, as components only grow.

    rows: sig, rep, component, n_shingles, sketch. A group is read in order and held as its sketches, folded to one length; blocks of it
    are compared with blocks, and only the pairs that may be linked leave the task.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types, held, now = {"sig": pa.int64(), "a": pa.int64(), "b": pa.int64()}, [], None

        def pairs(x: np.ndarray, y: np.ndarray):
            return rows_of({"sig": np.full(len(x), now, np.int64), "a": x, "b": y}, types)

        def told():
            if len(held) < 2:
                return
            rep, comp, n = (np.array([x[i] for x in held], np.int64) for i in range(3))
            if (comp == comp[0]).all():
                return
            least = min(len(x[3]) for x in held)
            bits = np.empty((len(held), least), np.uint8)
            for i, x in enumerate(held):
                y = np.frombuffer(x[3], np.uint8)
                while len(y) > least:
                    y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                bits[i] = y
            _, of, count = np.unique(comp, return_inverse=True, return_counts=True)
            order = np.argsort(of == count.argmax(), kind="stable")  # members of the largest component, last, aren't compared with each other
            rep, comp, n, bits = rep[order], comp[order], n[order], bits[order].view(np.uint64)
            others, most = len(held) - count.max(), np.iinfo(np.int64).max
            best, whom = np.full(len(held), most), np.zeros(len(held), np.int64)
            for i in range(0, others, block):
                p = slice(i, min(i + block, others))
                for j in range(i, len(held), block):
                    q = slice(j, j + block)
                    total = n[p, None] + n[None, q]
                    if total.size * bits.shape[1] <= 1 << 18:
                        apart = np.bitwise_count(bits[p, None] ^ bits[None, q]).sum(2, dtype=np.int64)
                    else:  # a word of the sketches at a time
                        apart = np.zeros(total.shape, np.int64)
                        for w in range(bits.shape[1]):
                            apart += np.bitwise_count(bits[p, None, w] ^ bits[None, q, w])
                    open_pairs = (100 * (total - apart) >= percent * (total + apart)) & (comp[p, None] != comp[None, q])
                    if nearest:
                        apart[~open_pairs] = most
                        for mine, of, yours in ((p, apart, q), (q, apart.T, p)):
                            at = of.argmin(1)
                            least_here = of[np.arange(len(at)), at]
                            closer = least_here < best[mine]
                            best[mine][closer], whom[mine][closer] = least_here[closer], rep[yours][at[closer]]
                    else:
                        x, y = np.nonzero(open_pairs if j > i else np.triu(open_pairs))
                        x, y = rep[p][x], rep[q][y]
                        yield from pairs(np.minimum(x, y), np.maximum(x, y))
            some = best < most
            yield from pairs(rep[some], whom[some])

        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                for sig, *row in zip(*(part.column(c).to_pylist() for c in ("sig", "rep", "component", "n_shingles", "sketch")), strict=True):
                    if sig != now:
                        yield from told()
                        held, now = [], sig
                    held.append(row)
        yield from told()

    return rows.select("sig", "rep", "component", "n_shingles", "sketch").repartition("sig").sortWithinPartitions("sig").mapInArrow(tidy(run), "sig long, a long, b long")


def unlike(rows: DataFrame) -> DataFrame:
    """rows (sig, rep, component) of groups with two components at least; of groups with the same members (sums of 128 bits of hashes) one."""
    about = rows.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"), *(F.sum(F.shiftrightunsigned(F.xxhash64("rep", F.lit(i)), 32)).alias(f"h{i}") for i in range(4)))
    groups = about.filter("low < high").groupBy("n", *(f"h{i}" for i in range(4))).agg(F.min("sig").alias("sig")).select("sig", "n")
    return rows.select("sig", "rep", "component").join(groups, "sig")


def only(docs: DataFrame, ids: DataFrame, broadcast_rows: int) -> DataFrame:
    """The rows of docs whose doc_id is in ids (staged, doc_id): by a broadcast up to so many ids, else by a join that both sides are dealt for."""
    fits, ids = small(ids, broadcast_rows)
    return docs.join(ids, "doc_id", "left_semi")


def measured(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, linked, far: the exact verdict on pairs."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                for x, y in zip(part.column("x"), part.column("y"), strict=True):
                    p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    either = len(p) + len(q) - both
                    out.append((100 * both >= percent * either, 100 * (either - both) > 2 * (100 - percent) * either))
            linked, far = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(far, pa.bool_())], ["a", "b", "linked", "far"])

    x, y = sets.select(F.col("rep").alias("a"), F.col("items").alias("x")), sets.select(F.col("rep").alias("b"), F.col("items").alias("y"))
    return pairs.select("a", "b").join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long, linked boolean, far boolean")


def sketched(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """a, b, maybe, far: whether the sketches leave room for a link, and whether they show that the two are far apart."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a = np.array([bits_apart(x, y) for i in range(0, batch.num_rows, 256) for x, y in zip(*(batch.slice(i, 256).column(c).to_pylist() for c in ("x", "y")), strict=True)], np.int64)
            total = batch.column("total").to_numpy(zero_copy_only=False)
            either2 = total + a  # twice the least union
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(100 * (total - a) >= percent * either2, pa.bool_()), pa.array(100 * 2 * a > 2 * (100 - percent) * either2, pa.bool_())], ["a", "b", "maybe", "far"])

    x, y = reps.select(F.col("rep").alias("a"), F.col("sketch").alias("x"), F.col("n_shingles").alias("n_a")), reps.select(F.col("rep").alias("b"), F.col("sketch").alias("y"), F.col("n_shingles").alias("n_b"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y", (F.col("n_a") + F.col("n_b")).alias("total")).mapInArrow(tidy(run), "a long, b long, maybe boolean, far boolean")


def named_by(members: DataFrame, label: DataFrame) -> DataFrame:
    return members.join(label.withColumnsRenamed({"node": "rep"}), "rep", "left").select("sig", "rep", F.coalesce("component", "rep").alias("component"))


def whole_sets(text: DataFrame, pairs: DataFrame, k: int, broadcast_rows: int) -> DataFrame:
    """(rep, items) of all that pairs (a, b) name, staged."""
    wanted = stage(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "wanted")
    return stage(shingle_sets(only(text, wanted, broadcast_rows), k), "items")


def measured_in_turns(pairs: DataFrame, text: DataFrame, k: int, percent: int, at_once: int, broadcast_rows: int) -> DataFrame:
    """measured() of pairs, staged, about at_once at a time, so that few copies of whole sets are on disk."""
    turns, out = max(1, -(-pairs.count() // at_once)), None
    for i in range(turns):
        some = pairs.filter(F.pmod(F.xxhash64("b", F.lit("turn")), F.lit(turns)) == i) if turns > 1 else pairs
        sets = whole_sets(text, some, k, broadcast_rows)
        found = stage(measured(some, sets, percent), "verdicts")
        unstage(sets)
        out = found if out is None else out.unionByName(found)
    return out


def open_members(members: DataFrame, verdict: DataFrame, broadcast_rows: int) -> DataFrame:
    """(sig, rep): what the leader leaves open: members of a group that are not linked to it; and those that are, if one of the others is not far. Groups of leaders that all are linked to are not dealt."""
    some = stage(verdict.filter("NOT linked").select(F.col("a").alias("leader")).distinct(), "wanted")
    state = members.filter("rep <> leader").join(small(some, broadcast_rows)[1], "leader", "left_semi")
    state = state.join(verdict.select(F.col("a").alias("leader"), F.col("b").alias("rep"), "linked", "far"), ["leader", "rep"])
    groups = state.groupBy("sig").agg(F.count_if(~F.col("linked")).alias("others"), F.count_if(~F.col("linked") & ~F.col("far")).alias("close"), F.count(F.lit(1)).alias("n"))
    groups = groups.filter("others > 1 OR (close > 0 AND n > 1)").select("sig", "close")
    return state.join(groups, "sig").filter("NOT linked OR close > 0").select("sig", "rep")


def blocks(over: DataFrame, split_over: int) -> DataFrame:
    """(sig, rep, component): groups of about split_over members, two blocks of a larger group (sig, rep, component, n) each, so that any two of its members meet."""
    n = F.ceil(F.lit(2) * F.col("n") / split_over)
    dealt = over.withColumn("own", F.pmod(F.xxhash64("rep"), n)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    dealt = dealt.filter("own <> other")
    return dealt.select(F.xxhash64("sig", F.least("own", "other"), F.greatest("own", "other")).alias("sig"), "rep", "component")


def parts_of(left: DataFrame, split_over: int) -> DataFrame:
    """left (sig, rep, component, n), where groups of over split_over members, at most a quarter as many of them outside the largest component, are cut: parts have some of its members and all others."""
    counts = left.filter(F.col("n") > split_over).groupBy("sig", "component", "n").agg(F.count(F.lit(1)).alias("held"))
    largest = counts.groupBy("sig", "n").agg(F.max_by("component", F.struct("held", "component")).alias("largest"), F.max("held").alias("held"))
    largest = stage(largest.filter((F.col("n") - F.col("held")) * 4 <= split_over).select("sig", "largest"), "largest")
    if largest.isEmpty():
        return left
    n = F.ceil(F.lit(2) * F.col("n") / split_over)
    dealt = left.join(largest, "sig").withColumn("part", F.explode(F.when(F.col("component") == F.col("largest"), F.array(F.pmod(F.xxhash64("rep"), n))).otherwise(F.sequence(F.lit(0).cast("long"), n - 1))))
    cut = unlike(stage(dealt.select(F.xxhash64("sig", "part", F.lit("part")).alias("sig"), "rep", "component"), "parts"))
    return stage(cut.unionByName(left.join(largest, "sig", "left_anti")), "open")


def split(left: DataFrame, text: DataFrame, k: int, percent: int, split_over: int, broadcast_rows: int, tasks: int) -> DataFrame:
    """left (sig, rep, component, n: members of the group) in groups that a task can hold.

    Groups over split_over are cut by parts_of; members of those that aren't are grouped by the signatures of other hashes, up to SPLITS
    times, each signed once, however many such groups it is in. What is larger even then is compared block by block, all such members as
    one group where that is less: no task holds more than about split_over members at once.
    """
    for seed in range(1, SPLITS + 2):
        left = parts_of(left, split_over)
        over = left.filter(F.col("n") > split_over)
        if over.isEmpty():
            return left
        wanted = stage(over.select("rep", "component").distinct(), "wanted")
        if seed <= SPLITS:
            some = only(text, wanted.select(F.col("rep").alias("doc_id")), broadcast_rows)
            parts = stage(grouped(signed(some, k, percent, seed, tasks), tasks, seed).join(wanted, "rep").select("sig", "rep", "component"), "parts")
        else:
            n = wanted.count()
            if n * n < over.agg(F.sum("n")).first()[0]:
                over = wanted.select(F.lit(0).cast("long").alias("sig"), "rep", "component", F.lit(n).cast("long").alias("n"))
            parts = stage(blocks(over, split_over), "parts")
        left = stage(unlike(parts).unionByName(left.filter(F.col("n") <= split_over)), "open")
    return left


def compared_in_turns(left: DataFrame, reps: DataFrame, percent: int, nearest: bool, at_once: int) -> DataFrame:
    """compared(), staged, of the groups of left (sig, rep, component), about at_once rows at a time; only a and b if not nearest."""
    turns, out = -(-left.count() // at_once), None
    for i in range(max(1, turns)):
        some = left.filter(F.pmod(F.xxhash64("sig", F.lit("turn")), F.lit(turns)) == i) if turns > 1 else left
        found = compared(some.join(reps.select("rep", "n_shingles", "sketch"), "rep"), percent, nearest)
        found = stage(found if nearest else found.select("a", "b").distinct(), "near")
        out = found if out is None else out.unionByName(found)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, split_over: int = 4096, broadcast_rows: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", unique: bool = False) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id, one row for each row of docs.

    class_id: the smallest doc_id with an equal set. component_id: the smallest doc_id that links reach, itself included; two rows link
    if 100 * intersection >= percent * union of their sets of k-word shingles. Null, empty and blank texts have the empty set and are
    linked with nothing; of fewer than k words all are one shingle. Equal rows are one class. Rows that share a doc_id but not the text
    are linked each by its own text, and rows with a null doc_id like all others; an id is null only where all that links reach are.
    Other columns of docs are not read, whatever their names; an empty table gives an empty result. unique: the ids are known to be
    there and not repeated.
    """
    text = docs.select(F.col(id_col).cast("long").alias("given"), F.col(text_col).alias("text"))
    text, renumbered = (text.withColumn("doc_id", F.col("given")), False) if unique else row_ids(text, "given", "doc_id", broadcast_rows)
    rows = stage(describe(text, k), "sets")
    reps = stage(rows.filter("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_rows"), F.max("n_shingles").alias("n_shingles"), F.max("sketch").alias("sketch")), "classes")
    copies = stage(rows.join(reps.filter("n_rows > 1").select("key", "rep"), "key").filter("doc_id <> rep").select("doc_id"), "copies")
    text = text.select("doc_id", "text")
    firsts = text.join(small(copies, broadcast_rows)[1], "doc_id", "left_anti")
    n, items = reps.agg(F.count(F.lit(1)), F.sum("n_shingles")).first()
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-2 * (items or 0) // (3 * PART)))  # two signatures for three items, about
    members = stage(grouped(signed(firsts, k, percent, parts=tasks), tasks), "members")

    pairs = members.filter("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    seen = stage(sketched(pairs, reps, percent), "sketched")
    wanted = seen.filter("maybe")
    pairs_at_once = max(n // PAIRS, PAIRS_ROWS)
    verdict = measured_in_turns(wanted, text, k, percent, pairs_at_once, broadcast_rows).unionByName(seen.filter("NOT maybe").select("a", "b", F.lit(False).alias("linked"), "far"))
    links = verdict.filter("linked").select("a", "b")
    label = components(links, FINISH)

    left = stage(open_members(members, verdict, broadcast_rows), "open")
    unstage(members)
    if not left.isEmpty():
        left = split(stage(unlike(named_by(left, label)), "open"), text, k, percent, split_over, broadcast_rows, tasks)
        done, full = verdict.select("a", "b"), False
        for round_ in range(NEAREST_ROUNDS + 1):
            full = full or round_ == NEAREST_ROUNDS
            near = compared_in_turns(left, reps, percent, not full, max(DEALT * n, DEALT_ROWS))
            maybe, joined = stage(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(done, ["a", "b"], "left_anti"), "maybe"), False
            if not maybe.isEmpty():
                found = stage(measured_in_turns(maybe, text, k, percent, pairs_at_once, broadcast_rows).filter("linked").select("a", "b"), "links")
                if joined := not found.isEmpty():
                    links = stage(links.union(found), "links")
                    label = components(links, FINISH)
                done = done.union(maybe)
            if full:
                break
            full = not joined  # as components are the same, so would be the nearest members
            left = stage(unlike(named_by(near.select("sig", F.col("a").alias("rep")), label)), "open")
            unstage(near)

    named = reps.select("key", "rep", "n_rows").join(label.withColumnsRenamed({"node": "rep"}), "rep", "left").select("key", "rep", "n_rows", F.coalesce("component", "rep").alias("component"))
    told = stage(named.filter(F.col("n_rows") + F.when(F.col("component") < F.col("rep"), 2).otherwise(0) > 1).select("key", "rep", "component"), "told")
    salts = 16  # a class of very many equal rows is spread over so many tasks
    got = rows.withColumn("salt", salt("doc_id", salts)).join(told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["key", "salt"], "left")
    got = got.select("doc_id", "given", "n_shingles", F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("component", "doc_id").alias("component_id"))
    if renumbered:
        got = stage(got, "numbered")
        for name in ("class_id", "component_id"):
            least = stage(got.groupBy(name).agg(F.min("given").alias("#least")), "least")
            got = got.join(small(least, broadcast_rows)[1], name).withColumn(f"#{name}", F.col("#least")).drop("#least")
        got = got.drop("class_id", "component_id").withColumnsRenamed({"#class_id": "class_id", "#component_id": "component_id"})
    return got.select(F.col("given").alias("doc_id"), "n_shingles", "class_id", "component_id")
