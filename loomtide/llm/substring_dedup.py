"""Repeated passages by collinear chaining of shared k-mer seeds.

Seeds are k-word windows chosen by winnowing: of every `window` neighbouring ones the least hash, so any two texts that share
k + window - 1 words in a row share a seed in them. A seed's occurrences are joined with its first one (smallest doc_id and position),
not with each other: rows grow with the occurrences, whatever a seed's frequency. The first occurrence of a seed that very many documents
have is found by partial minima and brought to the others, where they lie; rarer seeds are dealt by themselves. For each pair of documents the matched seeds are
chained: a chain goes forward in both texts, each seed scores k and each word of a gap costs; the best predecessor comes from
a Fenwick tree of prefix maxima over positions in the first text. Chains that may be part of a passage are aligned word by word, the
words being cut out of the first text, and those of the other one at hand. The matched words of all chains of a document are laid over each other, so a passage is
found whole even if its parts were first seen in different documents; all longest intervals of at least `min_words` words of which `share`
are matched, with gaps of at most `gap` words, are its repeated passages, whatever thinner stretch goes on beside them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import row_ids, salt, small, stage, tidy
from .jaccard_join import rows_of
from .sets import texts, windows, word_hashes, words_of

K, WINDOW, GAP_COST, MARGIN = 5, 8, 0.1, 16
#: Of the alignment within a chain: words off the straight line, and cells of its table, beyond which it is halved.
OFF, CELLS = 32, 4_000_000
#: Chains with one cut from which on it is dealt to several tasks, and to how many.
HOT, SALTS = 1_000, 16
#: Documents with one seed beyond which its occurrences stay where they are.
HOT_SEED = 10_000
#: Of the alignment beyond a chain's ends.
BAND, EDIT, DROP = 8, 0.5, 4


def winnow(h: np.ndarray, at: np.ndarray, k: int = K, window: int = WINDOW) -> np.ndarray:
    """Positions of the seeds among h, the k-word windows of all rows one after the other; at: the rows' offsets in words.

    A row of fewer than `window` windows has its least one. Of equal windows in a row only the first counts (the same few words
    again and again are no passage).
    """
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    last = np.repeat(at[1:], np.diff(at))[:n] - k  # the last window of the row
    inside = np.arange(n) <= last
    value = np.where(inside, h, np.uint64(2**64 - 1))
    best, arg = value.copy(), np.arange(n)
    for d in range(1, min(window, n)):
        ahead = value[d:]
        less = (ahead < best[:-d]) & (np.arange(d, n) <= last[:-d])
        best[:-d][less] = ahead[less]
        arg[:-d][less] = np.arange(d, n)[less]
    first = np.repeat(at[:-1], np.diff(at))[:n]
    full = inside & ((np.arange(n) + window - 1 <= last) | (np.arange(n) == first))
    chosen = np.unique(arg[full])
    again = np.concatenate([[False], (h[1:] == h[:-1]) & (first[1:] == first[:-1])])
    return chosen[~again[chosen]]


def seeds(docs: DataFrame) -> DataFrame:
    """(seed, doc_id, pos) of docs (doc_id not null, text); pos: all positions of the seed in the document, so that a seed has a row for each document at most."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            ids, column = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("text")
            for i, _, raw, at in texts(column.fill_null("") if column.null_count else column):
                words, at = words_of(raw, at)
                h = windows(words, K)
                pos = winnow(h, at)
                row = np.searchsorted(at, pos, side="right") - 1
                order = np.lexsort((pos, h[pos], row))
                pos, row = pos[order], row[order]
                seed = h[pos]
                first = np.flatnonzero(np.concatenate([[True], (seed[1:] != seed[:-1]) | (row[1:] != row[:-1])])[: len(pos)])
                places = pa.ListArray.from_arrays(pa.array(np.append(first, len(pos)), pa.int32()), pa.array((pos - at[row]).astype(np.int32)))
                for j in range(0, len(first), 65_536):
                    f = first[j : j + 65_536]
                    yield pa.RecordBatch.from_arrays([pa.array(seed[f].view(np.int64)), pa.array(ids[i + row[f]], pa.int64()), places.slice(j, 65_536)], ["seed", "doc_id", "pos"])

    return docs.mapInArrow(tidy(run), "seed long, doc_id long, pos array<int>")


def matches(seed_rows: DataFrame, broadcast_rows: int = 1_000_000, hot_seed: int = HOT_SEED) -> DataFrame:
    """(b, a, pos_b, pos_a): each occurrence of a seed in a document b after its first document a, with the first occurrence. seed_rows: staged.

    The occurrences of a seed that over hot_seed documents have never meet in one task: they are joined with its first one, which is
    the least of their partial minima. There are hot_seed times fewer such seeds than rows; beyond broadcast_rows they are dealt to SALTS tasks each.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = {"b": pa.int64(), "a": pa.int64(), "pos_b": pa.int32(), "pos_a": pa.int32()}
        held = None
        for batch in batches:
            seed, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("seed", "doc_id"))
            if not len(seed):
                continue
            n, all_pos = batch.column("pos").value_lengths().to_numpy(), batch.column("pos").flatten().to_numpy()
            pos = all_pos[np.cumsum(n) - n]  # the first ones
            new = np.concatenate([[held is None or seed[0] != held[0]], seed[1:] != seed[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(len(seed)), -1))
            a, pos_a = (np.where(start >= 0, x[start], 0 if held is None else held[i]) for i, x in ((1, doc), (2, pos)))
            held = int(seed[-1]), int(a[-1]), int(pos_a[-1])
            other = np.repeat(a != doc, n)
            told = {"b": doc, "a": a, "pos_a": pos_a.astype(np.int32)}
            told = {c: np.repeat(v, n)[other] for c, v in told.items()} | {"pos_b": all_pos[other]}
            yield from rows_of({c: told[c] for c in types}, types)

    about = seed_rows.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"))
    hot = stage(about.filter(F.col("n") > hot_seed).select("seed", "doc_id"), "hot_seeds")
    if hot.isEmpty():
        rare, often = seed_rows, None
    else:
        first = seed_rows.join(small(hot, broadcast_rows)[1], ["seed", "doc_id"]).select("seed", F.col("doc_id").alias("a"), F.col("pos")[0].alias("pos_a"))
        hot = stage(first, "hot_firsts")
        on, fits, rows = ["seed"], *small(hot, broadcast_rows)
        if not fits:
            on, hot = ["seed", "salt"], hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            seed_rows, rows = seed_rows.withColumn("salt", salt("doc_id", SALTS)), hot
        rare = seed_rows.join(rows, on, "left_anti").select("seed", "doc_id", "pos")
        often = seed_rows.join(rows, on).filter("doc_id <> a").select(F.col("doc_id").alias("b"), "a", F.explode("pos").alias("pos_b"), "pos_a")
    met = rare.repartition("seed").sortWithinPartitions("seed", "doc_id", "pos").mapInArrow(tidy(run), "b long, a long, pos_b int, pos_a int")
    return met if often is None else met.unionByName(often)


def chain(x: np.ndarray, y: np.ndarray, k: int = K, cost: float = GAP_COST) -> list[np.ndarray]:
    """Chains of the matches (x[i], y[i]), sorted by y: indices of each, best chains first, every match in one at most.

    score(i) = k + max(0, score(j) - cost * (x[i] - x[j] + y[i] - y[j])) over j with x[j] < x[i] and y[j] < y[i].
    """
    dx, dy = np.diff(x), np.diff(y)
    if (dx > 0).all() and (dy > 0).all() and (cost * (dx + dy) < k).all():
        return [np.arange(len(x))]  # gap costs add up along a chain, so each further match is a gain
    ranks = np.unique(x, return_inverse=True)[1] + 1
    size = int(ranks.max())
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (size + 1)
    score, before, waiting = [0.0] * len(x), [-1] * len(x), []
    xs, ys, rank = x.tolist(), y.tolist(), ranks.tolist()
    for i in range(len(xs)):
        if i and ys[i] != ys[i - 1]:
            for j in waiting:
                entry, r = (score[j] + cost * (xs[j] + ys[j]), j), rank[j]
                while r <= size:
                    if tree[r] < entry:
                        tree[r] = entry
                    r += r & -r
            waiting = []
        best, r = (-np.inf, -1), rank[i] - 1
        while r:
            if best < tree[r]:
                best = tree[r]
            r -= r & -r
        gain = best[0] - cost * (xs[i] + ys[i])
        score[i], before[i] = (k + gain, best[1]) if gain > 0 else (k, -1)
        waiting.append(i)
    used, out = [False] * len(xs), []
    for i in sorted(range(len(xs)), key=lambda i: (-score[i], i)):
        got = []
        while i >= 0 and not used[i]:
            used[i] = True
            got.append(i)
            i = before[i]
        if got:
            out.append(np.array(got[::-1]))
    return out


def chains(match_rows: DataFrame, min_words: int) -> DataFrame:
    """(b, a, low_a, high_a, spans): the chains that may be part of a passage: with MARGIN words at both ends, they and other chains of b cover min_words.

    low_a, high_a: a stretch of a with the chain and its margins, in steps of 32 words, so that a text is cut in few ways. spans: from_b, to_b, from_a, to_a of
    all chains of b that lie in the stretch, one after the other: a line that b has again and again gives one row.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["b", "a", "low_a", "high_a", "spans"]
        parts: list[tuple] = []

        def told(b: int, a: np.ndarray, y: np.ndarray, x: np.ndarray):
            found = []
            edge = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]])
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                for c in chain(x[i:j], y[i:j]):
                    p, q = i + int(c[0]), i + int(c[-1])
                    found.append((int(y[p]), int(y[q]) + K, int(x[p]), int(x[q]) + K, int(a[i])))
            found.sort()
            stretches: dict[tuple, list[int]] = {}
            i = 0
            while i < len(found):
                j, low, high = i, found[i][0] - MARGIN, found[i][1] + MARGIN
                while j < len(found) and found[j][0] - MARGIN <= high:
                    high = max(high, found[j][1] + MARGIN)
                    j += 1
                if high - max(low, 0) >= min_words:
                    for *span, of in found[i:j]:
                        stretches.setdefault((of, max(0, (span[2] - MARGIN) // 32 * 32), -(-(span[3] + MARGIN) // 32) * 32), []).extend(span)
                i = j
            return [(b, *key, spans) for key, spans in stretches.items()]

        def flush():
            b, a, y, x = (np.concatenate(c) for c in zip(*parts, strict=True))
            parts.clear()
            order = np.lexsort((x, y, a))
            return told(int(b[0]), a[order], y[order], x[order])

        def batch_of():
            types = [*[pa.int64()] * 4, pa.list_(pa.int32())]
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
            out.clear()
            return got

        out: list[tuple] = []
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("b", "a", "pos_b", "pos_a")]
            b = cols[0]
            if not len(b):
                continue
            edge = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]])
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if parts and parts[-1][0][0] != b[i]:
                    out += flush()
                parts.append(tuple(c[i:j] for c in cols))
            if len(out) > 10_000:
                yield batch_of()
        if parts:
            out += flush()
        if out:
            yield batch_of()

    return match_rows.repartition("b").sortWithinPartitions("b").mapInArrow(tidy(run), "b long, a long, low_a long, high_a long, spans array<int>")


def cut_out(docs: DataFrame, wanted: DataFrame, broadcast_rows: int) -> DataFrame:
    """(doc_id, low, high, words): the word hashes of docs from low on, up to high or, if null, the end; wanted: doc_id and its places (low, high), staged."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = {"doc_id": pa.int64(), "low": pa.int64(), "high": pa.int64(), "words": pa.binary()}
        for b in batches:
            column, ids, places = b.column("text"), b.column("doc_id"), b.column("places")
            for i, n, raw, at in texts(column.fill_null("") if column.null_count else column):
                words, at = words_of(raw, at)
                words = (words >> np.uint64(32)).astype(np.uint32)
                out: dict[str, list] = {c: [] for c in types}
                for r, (doc, cuts) in enumerate(zip(ids.slice(i, n).to_pylist(), places.slice(i, n).to_pylist(), strict=True)):
                    own = words[at[r] : at[r + 1]]
                    for cut in cuts:
                        low, high = cut["low"], cut["high"]
                        for c, v in zip(out, (doc, low, high, own[low : len(own) if high is None else high].tobytes()), strict=True):
                            out[c].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, types[c]) for c, v in out.items()], list(out))

    _, wanted = small(wanted, broadcast_rows, "places")
    return docs.join(wanted, "doc_id").select("doc_id", "places", "text").mapInArrow(tidy(run), "doc_id long, low long, high long, words binary")


def beyond(x: list[int], y: list[int]) -> list[int]:
    """The words of y, from its begin on, that the best banded alignment with x from its begin on matches.

    A match scores 1, an unequal, additional or missing word -EDIT; it ends at its best match (the last of equal ones), of score 0 at least,
    and isn't looked for once all scores lie DROP below the best.
    """
    y = y[: len(x) + BAND]
    if set(x).isdisjoint(y):
        return []
    rows = [[-EDIT * j for j in range(len(y) + 1)]]
    best, end, none = 0.0, None, float("-inf")
    for i, w in enumerate(x, 1):
        before, now = rows[-1], [none] * (len(y) + 1)
        if i <= BAND:
            now[0] = -EDIT * i
        for j in range(max(1, i - BAND), min(len(y), i + BAND) + 1):
            same = w == y[j - 1]
            now[j] = max(before[j - 1] + (1 if same else -EDIT), before[j] - EDIT, now[j - 1] - EDIT)
            if same and now[j] == before[j - 1] + 1 and now[j] >= best:
                best, end = now[j], (i, j)
        rows.append(now)
        if max(now) < best - DROP:
            break
    if end is None:
        return []
    (i, j), out = end, []
    while i and j:
        same = x[i - 1] == y[j - 1]
        if rows[i][j] == rows[i - 1][j - 1] + (1 if same else -EDIT):
            i, j = i - 1, j - 1
            if same:
                out.append(j)
        elif rows[i][j] == rows[i - 1][j] - EDIT:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def common(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """(i, j) of a longest common subsequence of the words x and y within a band about the straight line, row by row.

    Of a table over CELLS, both sides are cut at the 5 words nearest the middle of x that each of them has once; without any, words are
    compared place by place.
    """
    n, m = len(x), len(y)
    if not n or not m:
        return []
    low, high = min(0, m - n) - OFF, max(0, m - n) + OFF
    if n * (high - low + 1) > CELLS:
        (u, at_x, n_x), (v, at_y, n_y) = (np.unique(windows(z, K), return_index=True, return_counts=True) for z in (x.astype(np.uint64), y.astype(np.uint64)))
        _, i, j = np.intersect1d(u[n_x == 1], v[n_y == 1], assume_unique=True, return_indices=True)
        i, j = at_x[n_x == 1][i], at_y[n_y == 1][j]
        if not len(i):
            return [(int(i), int(i)) for i in np.flatnonzero(x[: min(n, m)] == y[: min(n, m)])]
        at = int(np.abs(i - n // 2).argmin())
        i, j = int(i[at]), int(j[at])
        rest = common(x[i + K :], y[j + K :])
        return common(x[:i], y[:j]) + [(i + d, j + d) for d in range(K)] + [(i + K + a, j + K + b) for a, b in rest]
    padded = np.concatenate([np.full(-low, -1), y, np.full(max(0, n + high - m), -1)]).astype(np.int64)  # y[i + d] is padded[i + d - low]
    width = high - low + 1
    rows, same = np.zeros((n + 1, width + 1), np.int32), np.empty((n, width), bool)
    for i in range(n):
        same[i] = padded[i : i + width] == x[i]
        np.maximum.accumulate(np.maximum(rows[i, :width] + same[i], rows[i, 1:]), out=rows[i + 1, :width])
    out, i, d = [], n - 1, m - n - low
    while i >= 0 and 0 <= i + d + low:
        best = rows[i + 1, d]
        if same[i, d] and best == rows[i, d] + 1:
            out.append((i, i + d + low))
            i -= 1
        elif best == rows[i, d + 1]:
            i, d = i - 1, d + 1
            if d == width:
                break
        elif d:
            d -= 1
        else:
            break
    return out[::-1]


def align(p: np.ndarray, q: np.ndarray, from_p: int, to_p: int, from_q: int, to_q: int) -> tuple[int, np.ndarray]:
    """Where the alignment begins in q, and which of its words from there on are matched. p, q: words; the chain goes from from_* to to_*.

    On one diagonal words are compared in place; else stretches of two words and more of a longest common subsequence count. Both ends
    are extended over equal words, then over edits.
    """
    while from_p and from_q and p[from_p - 1] == q[from_q - 1]:
        from_p, from_q = from_p - 1, from_q - 1
    while to_p < len(p) and to_q < len(q) and p[to_p] == q[to_q]:
        to_p, to_q = to_p + 1, to_q + 1
    x, y = p[from_p:to_p], q[from_q:to_q]
    if len(x) == len(y) and 5 * (same := x == y).sum() >= 4 * len(y):
        hit = same
    else:
        hit = np.zeros(len(y), bool)
        if met := common(x, y):
            i, j = np.array(met).T
            near = (np.diff(i) == 1) & (np.diff(j) == 1)
            hit[j[np.append(near, False) | np.append(False, near)]] = True
    left = beyond(p[:from_p][::-1].tolist(), q[max(0, from_q - from_p - BAND) : from_q][::-1].tolist())
    right = beyond(p[to_p:].tolist(), q[to_q : to_q + len(p) - to_p + BAND].tolist())
    if not left and not right:
        return from_q, hit
    n = left[-1] + 1 if left else 0
    out = np.zeros(n + len(hit) + (right[-1] + 1 if right else 0), bool)
    out[n : n + len(hit)] = hit
    out[[n - 1 - j for j in left] + [n + len(hit) + j for j in right]] = True
    return from_q - n, out


def runs(hit: np.ndarray, min_words: int, share: float, gap: int) -> list[tuple[int, int]]:
    """Intervals of at least min_words words, matched at both ends, with at most `gap` unmatched words in a row and `share` matched in all.

    Each is as long as can be, and every word of any such interval is in one of them; they overlap where two qualify and both together don't.
    """
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    out = []
    for part in np.split(at, np.flatnonzero(np.diff(at) > gap + 1) + 1):
        if part[-1] + 1 - part[0] < min_words:
            continue
        # from match i to match j the share is met if level[j] >= level[i] + share - 1
        level = np.arange(len(part)) - share * part
        ahead = np.maximum.accumulate(level[::-1])
        far = len(part) - 1 - np.searchsorted(ahead, level + share - 1 - 1e-9)  # the last such j
        starts = np.flatnonzero(part[far] + 1 - part >= min_words).tolist()
        reach, best, at_start = -1, -1, -1
        for i in starts:
            if i > reach + 1 and best > reach:
                out.append((int(part[at_start]), int(part[best]) + 1))
                reach = best
            if far[i] > max(best, reach):
                best, at_start = int(far[i]), i
        if best > reach:
            out.append((int(part[at_start]), int(part[best]) + 1))
    return out


def covered(chain_rows: DataFrame, crops: DataFrame, min_words: int, share: float, gap: int, broadcast_rows: int) -> DataFrame:
    """The repeated passages: each text b meets its chains with their cuts of first texts, aligns them, and lays the matched words over each other.

    A cut that over HOT chains need is dealt to SALTS tasks.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names, hits, now, words, out = ["doc_id", "start_word", "n_words", "matched_words", "source_doc_id"], [], None, None, []

        def told():
            cover = np.zeros(len(words), bool)
            for _, f, h in hits:
                cover[f : f + len(h)] |= h
            for i, j in runs(cover, min_words, share, gap):
                shares: dict[int, int] = {}
                for a, f, h in hits:
                    if n := int(h[max(0, i - f) : max(0, j - f)].sum()):
                        shares[a] = shares.get(a, 0) + n
                out.append((now, i, j - i, int(cover[i:j].sum()), min(shares, key=lambda a: (-shares[a], a))))

        def batch_of():
            got = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)
            out.clear()
            return got

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for b, a, low, spans, cut in zip(*(part.column(c).to_pylist() for c in ("b", "a", "low", "spans", "words")), strict=True):
                    if a is None:  # a text comes before its chains
                        if hits:
                            told()
                            hits = []
                        now, words = b, np.frombuffer(cut, np.uint32)
                        continue
                    p = np.frombuffer(cut, np.uint32)
                    for fb, tb, fa, ta in zip(*[iter(spans)] * 4, strict=True):
                        hits.append((a, *align(p, words, fa - low, ta - low, fb, tb)))
            if len(out) > 10_000:
                yield batch_of()
        if hits:
            told()
        if out:
            yield batch_of()

    whole, place = F.col("high").isNull(), ["a", "low_a", "high_a"]
    hot = stage(chain_rows.groupBy(*place).count().filter(F.col("count") > HOT).select(*place, F.lit(SALTS).alias("salts")), "hot_cuts")  # one in HOT chains at most
    hot = small(hot, broadcast_rows)[1]
    first = crops.filter(~whole).select(F.col("doc_id").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"), "words")
    first = first.join(hot, place, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    dealt = chain_rows.join(hot, place, "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(salt("b", SALTS)))
    cuts = dealt.join(first, [*place, "salt"]).select("b", "a", F.col("low_a").alias("low"), "spans", "words")
    own = crops.filter(whole).select(F.col("doc_id").alias("b"), F.lit(None).cast("long").alias("a"), F.lit(0).cast("long").alias("low"), F.lit(None).cast("array<int>").alias("spans"), "words")
    both = own.unionByName(cuts).repartition("b").sortWithinPartitions("b", F.col("a").asc_nulls_first(), "low")
    return both.mapInArrow(tidy(run), "doc_id long, start_word long, n_words long, matched_words long, source_doc_id long")


def repeated_passages(docs: DataFrame, min_words: int = 50, share: float = 0.8, gap: int = 8, broadcast_rows: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", unique: bool = False, hot_seed: int = HOT_SEED) -> DataFrame:
    """doc_id, start_word, n_words, matched_words, source_doc_id: the passages of documents that earlier documents (by doc_id) hold too.

    Words are [^\\x20\\x09-\\x0D]+, A-Z in lower case; positions count them. Beyond its outer seeds a passage is followed over edits, as far
    as MARGIN words at least, in the first document with the seed. Where that one holds another version and a later one this version, up to
    WINDOW - 1 words at an end may be missing; a passage that has fewer than min_words words without them has no row. source_doc_id has the largest part of the passage. A first
    occurrence, a text of fewer than min_words words, null and empty texts have no row; repeats within one document aren't looked for.
    Rows that share a doc_id are texts of their own, and may be each other's first occurrence; so are rows without a doc_id, whose id is
    null. An empty table gives an empty result. Other columns of docs are not read, whatever their names. unique: the ids are known to
    be there and not repeated.
    """
    text = docs.select(F.col(id_col).cast("long").alias("given"), F.col(text_col).alias("text"))
    text, renumbered = (text.withColumn("doc_id", F.col("given")), False) if unique else row_ids(text, "given", "doc_id", broadcast_rows)
    given, text = text.select("doc_id", "given"), text.select("doc_id", "text")
    found = stage(chains(matches(stage(seeds(text), "seeds"), broadcast_rows, hot_seed), min_words), "chains")
    none = F.lit(None).cast("long")
    wanted = found.select(F.col("a").alias("doc_id"), F.col("low_a").alias("low"), F.col("high_a").alias("high")).distinct().union(found.select("b", F.lit(0).cast("long"), none).distinct())
    wanted = stage(wanted.groupBy("doc_id").agg(F.collect_list(F.struct("low", "high")).alias("places")), "wanted")  # as many as a text has stretches
    crops = stage(cut_out(text, wanted, broadcast_rows), "crops")
    got = covered(found, crops, min_words, share, gap, broadcast_rows)
    if renumbered:
        for name in ("doc_id", "source_doc_id"):
            names = given.select(F.col("doc_id").alias(name), F.col("given").alias(f"#{name}"))
            got = got.join(names, name).drop(name).withColumnRenamed(f"#{name}", name)
    return got.select("doc_id", "start_word", "n_words", "matched_words", "source_doc_id")


def remove_passages(docs: DataFrame, passages: DataFrame, broadcast_rows: int = 1_000_000, id_col: str = "doc_id") -> DataFrame:
    """docs with the passages (doc_id, start_word, n_words) cut out of their texts and n_chars, if there, set anew; texts left without a word go.

    id_col: of docs, met with the passages' doc_id; rows that share an id are all cut. Rows without a passage stay as they are, whatever
    columns they have; only the others are read in Python.
    """
    spans = stage(passages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_word", "n_words"))).alias("#spans")), "spans")  # they may overlap, but none lies in another
    spans = spans.withColumnRenamed("doc_id", "#doc")
    ids, spans = small(spans.select("#doc"), broadcast_rows)[1], small(spans, broadcast_rows, "#spans")[1]
    names, schema, on = docs.columns, docs.schema, F.col(f"`{id_col}`") == F.col("#doc")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out, keep = [], []
                for text, cut in zip(part.column("text").to_pylist(), part.column("#spans").to_pylist(), strict=True):
                    raw = text.encode()
                    start, end, _ = word_hashes(np.frombuffer(raw, np.uint8))
                    pieces, at = [], 0
                    for s in cut:
                        if s["start_word"] < len(start):
                            pieces.append(raw[at : start[s["start_word"]]])
                            at = int(end[min(len(end), s["start_word"] + s["n_words"]) - 1])
                    out.append(b"".join([*pieces, raw[at:]]).decode())
                    keep.append(bool(out[-1].encode().split()))
                new = {"text": pa.array(out, pa.string()), "n_chars": pa.array(map(len, out), pa.int64())}
                table = pa.RecordBatch.from_arrays([new[c].cast(part.column(c).type) if c in new else part.column(c) for c in names], names)
                yield table.filter(pa.array(keep, pa.bool_()))

    cut = docs.join(spans, on).select(*(F.col(f"`{c}`") for c in names), "#spans").mapInArrow(tidy(run), schema)
    return docs.join(ids, on, "left_anti").unionByName(cut)
