"""The training-data operators against brute force, exact round trips and held-out labels."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomtide.llm import exact_dedup, html_tree, jaccard_join, packing, preference_format, quality_crf, quality_rules, sentencepieces, sets, substring_dedup, training_order
from loomtide.llm.tokens import ChunkIds
from loomtide.operators import components as components_module
from loomtide.operators.staging import stage, unstage

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " \n\t ", "one", "one two three four", "x" * 5000, "日本語 テキスト é", "a\x0bb\x1cc"]


def words(r, n, size=400):
    return [f"w{r.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Near copies that chain away from each other, exact copies, shared passages, odd texts, repeated rows and a row without an id."""
    r = random.Random(5)
    texts = []
    for family in range(6):
        base = words(r, r.choice([40, 90, 150]), 3000)
        for _ in range(12):
            texts.append(" ".join(base))
            for _ in range(r.randint(0, 3)):
                base[r.randrange(len(base))] = f"e{r.randrange(9999)}"
    passage = words(r, 70, 5000)
    for _ in range(8):
        texts.append(" ".join(words(r, r.randint(0, 60), 4000) + passage + words(r, r.randint(5, 60), 4000)))
    texts += [" ".join(words(r, r.randint(1, 80), 30)) for _ in range(40)] + ODD + ODD + [texts[3], texts[3]]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[4], (None, texts[5], None, None, None), (None, "alone and without an id", None, None, None)]
    return rows, spark.createDataFrame(rows, DOCS).repartition(3).cache()


def shingle_set(text, k=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(rows):
    """(doc_id, n_shingles, class_id, component_id) of each row, by all pairs."""
    sets_of = [shingle_set(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in enumerate(sets_of):
        for b, y in enumerate(sets_of[:a]):
            if x and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    least = lambda some: min((rows[j][0] for j in some if rows[j][0] is not None), default=None)
    out = []
    for i, x in enumerate(sets_of):
        same = [j for j, y in enumerate(sets_of) if x == y] if x else [i]
        out.append((rows[i][0], len(x), least(same), least(j for j in range(len(rows)) if find(j) == find(i))))
    return Counter(out)


def test_jaccard_join(corpus):
    rows, df = corpus
    assert Counter(map(tuple, jaccard_join.near_duplicates(df).collect())) == components(rows)


def test_jaccard_join_in_split_groups(corpus):
    rows, df = corpus
    assert Counter(map(tuple, jaccard_join.near_duplicates(df.withColumnRenamed("lang", "component_id"), split_over=2, broadcast_rows=0).collect())) == components(rows)


def test_jaccard_join_by_blocks(corpus, spark, monkeypatch):
    rows, df = corpus
    monkeypatch.setattr(jaccard_join, "SPLITS", 0)
    assert Counter(map(tuple, jaccard_join.near_duplicates(df, split_over=2).collect())) == components(rows)
    over = spark.createDataFrame([(sig, 100 * sig + i, i, n) for sig, n in ((1, 50), (2, 11)) for i in range(n)], "sig long, rep long, component long, n long")
    groups = defaultdict(set)
    for x in jaccard_join.blocks(over, 10).collect():
        groups[x.sig].add(x.rep)
    met = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    assert met == {(100 * s + a, 100 * s + b) for s, n in ((1, 50), (2, 11)) for b in range(n) for a in range(b)}
    assert max(map(len, groups.values())) < 25


def test_jaccard_join_takes_few_stages(corpus, monkeypatch):
    """A component's links are followed in one table, not in rounds of joins; a round of nearest members that joins nothing is the last but one."""
    rows, df = corpus
    seen, found = Counter(), []

    def counted(some, name, stage=jaccard_join.stage):
        seen[name] += 1
        out = stage(some, name)
        if name == "links":
            found.append(out.isEmpty())
        return out

    monkeypatch.setattr(jaccard_join, "stage", counted)
    monkeypatch.setattr(components_module, "stage", counted)
    assert Counter(map(tuple, jaccard_join.near_duplicates(df).collect())) == components(rows)
    assert 0 < seen["hooks"] <= seen["edges"] and not seen["labels"]
    assert seen["near"] <= 1 + len(found) + 1 and found.count(True) <= 2


def test_jaccard_join_deals_few_whole_sets_at_once(spark, monkeypatch):
    """Where all texts have near copies, whole sets are dealt in turns and go, members too; groups that are linked to their leader aren't dealt again."""
    r, held, made = random.Random(8), [], Counter()
    rows = []
    for family in range(30):
        base = " ".join(words(r, 60, 9000))
        rows += [(100 * copy + family, f"{base} copy{copy}") for copy in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def counted(some, name, stage=jaccard_join.stage):
        out = stage(some, name)
        made[name] = max(made[name], out.count())
        if name in ("items", "members"):
            held.append(Path(out.inputFiles()[0].removeprefix("file://")).parent)
        return out

    monkeypatch.setattr(jaccard_join, "stage", counted)
    monkeypatch.setattr(jaccard_join, "PAIRS_ROWS", 20)
    monkeypatch.setattr(jaccard_join, "PAIRS", 10)
    assert Counter(map(tuple, jaccard_join.near_duplicates(df).collect())) == components(rows)
    assert len(held) > 4 and 0 < made["items"] < 80 and not any(path.exists() for path in held)
    assert made["members"] and not made["open"]


def test_signatures_are_dealt_in_few_bytes(corpus):
    _, df = corpus
    docs = df.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text").cache()
    plain = defaultdict(set)
    for x in jaccard_join.signed(docs, 5, 80).collect():
        plain[x.sig].add(x.rep)
    groups = Counter(frozenset(x) for x in plain.values() if len(x) > 1)
    for parts in (1, 7):
        dealt = jaccard_join.signed(docs, 5, 80, parts=parts)
        blobs = dealt.selectExpr("sum(length(sigs) + length(reps)) AS bytes", "min(part) AS low", "max(part) AS high").first()
        assert blobs.bytes < 7 * sum(map(len, plain.values())) and 0 <= blobs.low <= blobs.high < parts
        got = defaultdict(set)
        for x in jaccard_join.grouped(dealt, parts).collect():
            got[x.sig, x.leader].add(x.rep)
        assert Counter(map(frozenset, got.values())) == groups and all(min(reps) == leader for (_, leader), reps in got.items())


def test_packed_signatures_come_back():
    r = np.random.default_rng(3)
    for ids in (np.array([7]), np.arange(-3, 4), np.array([-(2**63), 0, 2**63 - 1])):
        sig, rep = r.integers(0, 2**64 - 1, 500, np.uint64, endpoint=True), r.choice(ids, 500)
        for parts in (1, 3, 1000):
            batch = jaccard_join.pack(sig, rep, parts)
            got = [jaccard_join.unpack(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            part = [(int(s) >> 32) * parts >> 32 for s in sig]
            want = Counter((p << 40 | int(s) & (1 << 40) - 1, int(i)) for p, s, i in zip(part, sig, rep, strict=True))
            assert Counter((int(s), int(i)) for x, y in got for s, i in zip(x, y, strict=True)) == want
            assert sorted(batch.column("part").to_pylist()) == sorted(set(part))


def test_components_at_the_driver(spark):
    r = random.Random(9)
    links = [(r.randrange(400) - 50, r.randrange(400) - 50) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(100)] + [(7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    some, full = ({x.node: x.component for x in components_module.components(df, finish).collect()} for finish in (0, 1000))
    assert some == full and full[1100] == 1000
    assert {x.node: x.component for x in components_module.components(df, 150).collect()} == full
    assert components_module.components(df.filter("a = b"), 1000).count() == 0


def test_staged_tables_go(spark):
    kept, gone = stage(spark.range(5), "kept"), stage(spark.range(7), "gone")
    path = gone.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    unstage(gone)
    assert not Path(path).exists() and kept.count() == 5


def test_jaccard_join_signs_members_of_large_groups_once(spark, monkeypatch):
    r = random.Random(5)
    base, seen = words(r, 300), Counter()
    rows = [(i, " ".join(w if r.random() > 0.015 else f"other{i}" for w in base)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def counted(some, name, stage=jaccard_join.stage):
        out = stage(some, name)
        seen[name] = max(seen[name], out.count())
        return out

    monkeypatch.setattr(jaccard_join, "stage", counted)
    assert Counter(map(tuple, jaccard_join.near_duplicates(df, split_over=8).collect())) == components(rows)
    assert 0 < seen["parts"] < 2 * jaccard_join.signed(df, 5, 80).count()


def test_parts_of_groups_of_one_component(spark):
    split_over, groups = 24, {1: (200, 6), 2: (45, 1), 3: (60, 30), 4: (9, 3)}  # members, those outside the largest component
    rows = [(sig, 1000 * sig + i, 1000 * sig + max(i - n + others + 1, 0), n) for sig, (n, others) in groups.items() for i in range(n)]
    got = defaultdict(dict)
    for x in jaccard_join.parts_of(spark.createDataFrame(rows, "sig long, rep long, component long, n long"), split_over).collect():
        got[x.sig][x.rep] = x.component
    pairs = lambda g: {(a, b) for a in g for b in g if a < b and g[a] != g[b]}
    given = [{rep: c for s, rep, c, _ in rows if s == sig} for sig in groups]
    assert set().union(*map(pairs, got.values())) == set().union(*map(pairs, given))
    assert sum(map(len, got.values())) <= 2 * len(rows)
    assert all(len(g) < 2 * split_over for sig, g in got.items() if sig != 3) and got[3] == given[2] and got[4] == given[3]


def test_compared_leaves_out_pairs_of_a_component(spark):
    r = np.random.default_rng(6)
    base = np.unique(r.integers(0, 2**63, 300, dtype=np.uint64))
    items = [np.sort(np.concatenate([base[6 * i :], r.integers(0, 2**63, 6 * i, dtype=np.uint64)])) for i in range(9)]
    comps = [5, 0, 0, 3, 0, 3, 0, 0, 8]
    df = spark.createDataFrame([(3, i, comps[i], len(x), bytearray(sets.odd_sketch(x))) for i, x in enumerate(items)], "sig long, rep long, component long, n_shingles long, sketch binary")
    apart = {(i, j): sets.bits_apart(*map(sets.odd_sketch, (items[i], items[j]))) for j in range(9) for i in range(9) if comps[i] != comps[j]}
    maybe = {(i, j): d for (i, j), d in apart.items() if 100 * (len(items[i]) + len(items[j]) - d) >= 80 * (len(items[i]) + len(items[j]) + d)}
    for block in (2, 4, 50):
        assert {(x.a, x.b) for x in jaccard_join.compared(df, 80, nearest=False, block=block).collect()} == {p for p in maybe if p[0] < p[1]}
        near = {x.a: x.b for x in jaccard_join.compared(df, 80, nearest=True, block=block).collect()}
        assert near.keys() == {i for i, _ in maybe} and all(maybe[i, j] == min(d for p, d in maybe.items() if p[0] == i) for i, j in near.items())


def test_shuffle_files_go_with_a_staged_table(spark):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("shuffle_")
    before = files()
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    staged = stage(df, "some")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and staged.count() == 7


def test_jaccard_join_of_repeated_ids(spark):
    r = random.Random(8)
    a, b = words(r, 60), words(r, 60)
    texts = [(1, a), (5, a), (5, b), (9, [*b[:-1], "changed"]), (None, [*a[:-1], "changed"]), (None, words(r, 60)), (7, a), (7, a), (2, []), (2, b)]
    rows = [(i, " ".join(t)) for i, t in texts]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == components(rows)
    assert {x.component_id for x in got if x.doc_id == 9} == {2}


def test_nearest_of_each_member(spark):
    r = np.random.default_rng(4)
    base = np.unique(r.integers(0, 2**63, 300, dtype=np.uint64))
    items = [np.sort(np.concatenate([base[8 * i :], r.integers(0, 2**63, 8 * i, dtype=np.uint64)])) for i in range(7)]
    rows = [(3, i, i if i else 1, len(x), bytearray(sets.odd_sketch(x))) for i, x in enumerate(items)]
    df = spark.createDataFrame(rows, "sig long, rep long, component long, n_shingles long, sketch binary")
    near = jaccard_join.compared(df, 80, nearest=True, block=3).collect()
    whole = {(x.a, x.b) for x in jaccard_join.compared(df, 80, nearest=False, block=3).collect()}
    assert len(near) == len({x.a for x in near}) and {x.a for x in near} == {i for p in whole for i in p}
    assert {tuple(sorted((x.a, x.b))) for x in near} <= whole and (0, 1) not in whole


def test_partners_share_a_signature():
    r = np.random.default_rng(1)
    for n in [5, 6, 9, 13, 40, 150, 700]:
        for _ in range(60):
            x = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
            gone = int(r.integers(0, n // 9 + 1))
            more = int(r.integers(0, max(1, int((len(x) - gone) / 0.8 - len(x)) + 1)))
            y = np.unique(np.concatenate([x[gone:], r.integers(0, 2**63, more, dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both < 80 * (len(x) + len(y) - both) or len(x) == len(y) == both:
                continue
            row, sig = jaccard_join.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), 80)
            assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist())
            assert sets.bits_apart(sets.odd_sketch(x), sets.odd_sketch(y)) <= len(x) + len(y) - 2 * both


def test_exact_dedup(corpus):
    rows, df = corpus
    groups = defaultdict(list)
    norm = lambda t: " ".join(__import__("re").split(r"[\x20\x09-\x0D]+", t or ""))
    for i, t, *_ in rows:
        groups[norm(t)].append(i)
    got = exact_dedup.exact_dedup(df, runs=8, fan_bits=1).collect()
    assert len(got) == len(rows)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
    for r in got:
        g = by_hash[r.text_sha256]
        least = min((x for x in g if x is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (least, len(g), r.doc_id == least)


def test_substring_dedup(corpus):
    rows, df = corpus
    rows = rows[:-3]  # without the repeated id and the nulls
    found = defaultdict(set)
    for r in substring_dedup.repeated_passages(df.sparkSession.createDataFrame(rows, DOCS).repartition(3)).collect():
        assert r.source_doc_id < r.doc_id and r.n_words >= 50
        found[r.doc_id] |= set(range(r.start_word, r.start_word + r.n_words))
    seen, edge = set(), substring_dedup.WINDOW - 1  # where the first document with the last seed goes on otherwise
    for i, t in sorted({(i, t or "") for i, t, *_ in rows if i is not None}):
        w = t.encode().lower().split()
        grams = [b" ".join(w[k : k + 50]) for k in range(len(w) - 49)]
        for k, g in enumerate(grams):
            if g in seen:
                assert set(range(k + edge, k + 50 - edge)) <= found[i], i
        seen.update(grams)
    assert not set(found) & {0, *range(81, 120)}  # first of all, and texts of chance


def test_substring_dedup_of_hot_seeds(corpus):
    _, df = corpus
    of = lambda **more: Counter(map(tuple, substring_dedup.repeated_passages(df.dropna(subset=["doc_id"]).dropDuplicates(["doc_id"]), **more).collect()))
    rare = of()
    assert rare and of(hot_seed=1) == of(hot_seed=4, broadcast_rows=0) == rare


def test_substring_dedup_of_repeated_ids(spark):
    r = random.Random(12)
    a, b, c = (words(r, 80, 5000) for _ in range(3))
    rows = [(1, " ".join(a)), (5, " ".join(b)), (5, " ".join([*c[:20], *a])), (None, " ".join([*b, "x"])), (9, " ".join(c)), (9, None)]
    df = spark.createDataFrame([(*x, 3) for x in rows], "doc_id long, text string, doc long")
    got = sorted(map(tuple, substring_dedup.repeated_passages(df).collect()), key=str)
    assert got == [(5, 20, 80, 80, 1), (None, 0, 80, 80, 5)] or got == [(5, 0, 80, 80, None), (5, 20, 80, 80, 1)]  # of rows without an id of their own either may be first


def test_common_subsequence():
    r = random.Random(2)
    for cells in (substring_dedup.CELLS, 400):
        for _ in range(60):
            x = [r.randrange(400) for _ in range(r.randint(1, 90))]
            y = list(x)
            for _ in range(r.randint(0, 6)):
                at = r.randrange(len(y) + 1)
                y[at : at + r.choice([0, 1, 2])] = [1000 + r.randrange(9) for _ in range(r.randint(0, 3))]
            table = np.zeros((len(x) + 1, len(y) + 1), int)
            for i, v in enumerate(x):
                for j, w in enumerate(y):
                    table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + (v == w))
            substring_dedup.CELLS, old = cells, substring_dedup.CELLS
            met = substring_dedup.common(np.array(x, np.uint32), np.array(y, np.uint32))
            substring_dedup.CELLS = old
            assert all(x[i] == y[j] for i, j in met) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(met, met[1:], strict=False))
            assert cells < 10**6 or len(met) == table[-1, -1]


def test_repetitive_and_long_stretches_are_aligned_in_time():
    import time

    began = time.time()
    x = np.array([1, 2] * 15_000, np.uint32)
    assert len(substring_dedup.common(x, np.concatenate([x[:9], [7, 7, 7], x[9:]]).astype(np.uint32))) >= 29_000 and time.time() - began < 20


def test_removed_passages(corpus, spark):
    _, df = corpus
    out = {r.doc_id: r for r in substring_dedup.remove_passages(df, spark.createDataFrame([(1, 1, 2), (1, 5, 9999)], "doc_id long, start_word long, n_words long")).collect()}
    before = {r.doc_id: r.text for r in df.collect()}
    assert out[1].text.split() == [w for i, w in enumerate(before[1].split()) if i in (0, 3, 4)] and out[1].n_chars == len(out[1].text)
    assert out[2].text == before[2]


def test_short_passages_with_edits_near_their_ends(spark):
    r, rows, want = random.Random(8), [], {}
    for k in range(600):
        n = r.randint(50, 70)
        first = [f"{k}p{i}" for i in range(n)]
        then = list(first)
        near, far = r.randint(1, 12), n - 1 - r.randint(1, 12)
        kind = k % 4
        if kind < 3:
            then[near] = f"{k}x"
        if kind == 1:
            then[far] = f"{k}y"
        if kind == 2:
            del first[far]
        if kind == 3:
            then.insert(far, f"{k}z")
        around = lambda c: [f"{k}{c}{i}" for i in range(r.randint(1, 40))]  # noqa: B023, E731
        start = around("a")
        rows += [(2 * k, " ".join(around("b") + first + around("c"))), (2 * k + 1, " ".join(start + then + around("d")))]
        want[2 * k + 1] = len(start), len(then)
    got = {x.doc_id: (x.start_word, x.n_words) for x in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_runs_are_all_found():
    hit = lambda *n: np.concatenate([np.full(k, i % 2 == 0) for i, k in enumerate(n)])
    beside = [(70, *[8, 12] * 6), (70, *[8, 6] * 5), (*[12, 8] * 6, 70)]
    for n in beside:
        assert set(range(70) if n[0] == 70 else range(120, 190)) <= {w for i, j in substring_dedup.runs(hit(*n), 50, 0.8, 8) for w in range(i, j)}
    r = np.random.default_rng(6)
    for _ in range(300):
        h = np.concatenate([r.random(int(r.integers(5, 90))) < p for p in r.choice([0.3, 0.7, 0.8, 0.9, 1], 5)])
        want, sums = set(), np.append(0, np.cumsum(h))
        for i in np.flatnonzero(h).tolist():
            for j in np.flatnonzero(h).tolist():
                if j + 1 - i >= 50 and 10 * (sums[j + 1] - sums[i]) >= 8 * (j + 1 - i) and np.diff(np.flatnonzero(h[i : j + 1])).max() <= 9:
                    want.add((i, j + 1))
        got = substring_dedup.runs(h, 50, 0.8, 8)
        assert set(got) <= want and {w for x in got for w in range(*x)} == {w for x in want for w in range(*x)}
        assert not any(a != b and b[0] <= a[0] and a[1] <= b[1] for a in got for b in want)


def test_chain_is_the_best():
    r = random.Random(2)
    for _ in range(40):
        pts = sorted({(r.randrange(60), r.randrange(60)) for _ in range(12)}, key=lambda p: p[1])
        x, y = np.array([p[0] for p in pts]), np.array([p[1] for p in pts])
        best = []
        for i in range(len(pts)):
            best.append(5 + max([0.0] + [best[j] - 0.1 * (x[i] - x[j] + y[i] - y[j]) for j in range(i) if x[j] < x[i] and y[j] < y[i]]))
        c = substring_dedup.chain(x, y)
        score = lambda c: 5 * len(c) - 0.1 * sum(x[b] - x[a] + y[b] - y[a] for a, b in zip(c, c[1:]))
        assert abs(score(c[0]) - max(best)) < 1e-9 and sorted(i for k in c for i in k) == list(range(len(pts)))


def test_packing(corpus):
    rows, df = corpus
    for limits in (packing.Limits(), packing.Limits(256, 3, 100)):
        got = packing.pack(df.withColumn("p", df.n_chars % 7), WORDS, limits, open_bins=4, prompt_col="p").collect()
        seqs, docs = defaultdict(list), defaultdict(list)
        for r in got:
            seqs[r.sequence_id].append(r)
            docs[r.doc_id, r.doc_tokens].append(r)
        for s in seqs.values():
            s.sort(key=lambda r: r.offset)
            assert [r.offset for r in s] == [sum(x.length for x in s[:i]) for i in range(len(s))]
            total = sum(r.length for r in s)
            assert total & (total - 1) == 0 and total <= limits.tokens and len(s) <= limits.segments and sum(r.loss for r in s) <= limits.loss
        ids_of = ChunkIds(WORDS).tokenizer
        want = Counter()
        for i, t, *_ in rows:
            want[i] += len(ids_of.encode(t or "", add_special_tokens=False).ids) + 1
        have = Counter()
        for r in got:
            have[r.doc_id] += r.length
            assert zlib.crc32(r.ids) == zlib.crc32(np.frombuffer(r.ids, "<u4").tobytes())
        assert want == have
        repeated = {i for i, n in Counter(i for i, *_ in rows).items() if n > 1}
        for i, t, *_ in rows:
            if i not in repeated:  # every piece of a document, against the library
                own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
                assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
                assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == [*ids_of.encode(t or "", add_special_tokens=False).ids, 1]


def test_training_order(corpus, tmp_path):
    rows, df = corpus
    for n in (1, 2, 7, 64, 1000):
        assert sorted(training_order.permuted(np.arange(n), n, 3).tolist()) == list(range(n))
    got = training_order.materialise(df, WORDS, f"file://{tmp_path}/out", length=64, shard=10).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    data = training_order.read_slots(f"{tmp_path}/out", 0, 10**6, 64, 10)
    assert len(data) == len(got) and all(zlib.crc32(data[r.slot].tobytes()) == r.ids_crc32 and r.byte_offset == r.slot % 10 * 128 for r in got)
    assert (training_order.read_slots(f"{tmp_path}/out", 7, 9, 64, 10) == data[7:16]).all()
    ids_of = ChunkIds(WORDS)
    assert sum(r.n_tokens for r in got) == sum(len(x) + 1 for x in ids_of.encode_list([t for _, t, *_ in rows]))


def test_chunks_are_exact(monkeypatch):
    from loomtide.llm import tokens

    r = random.Random(6)
    mixed = lambda: "".join(r.choice("abcdeEFGé ÀÖßÿ.,!'-0129 \n\x1c\u00a0ł日") for _ in range(r.randint(0, 60)))
    texts = ["Ünïcödé's <|endoftext|> x<|endoftext|>y ÀÉ, don't, éA 12a! x²", "é Å", "x</w>y </w>", "a" * 300 + " b", *[t or "" for t in ODD], *[" ".join(words(random.Random(i), 60)) for i in range(5)], *[mixed() for _ in range(300)]]
    for path in (WORDS, public_tokenizers.path("byte_bpe_50k.json")):
        if path == WORDS:
            for most in (64_000_000, 3_000):  # the memo is emptied again and again
                ids_of = ChunkIds(path, most)
                assert ids_of.folds and ids_of.merges
                for i in range(0, len(texts), 40):
                    for a, e in zip(ids_of.encode_list(texts[i : i + 40]), ids_of.tokenizer.encode_batch(texts[i : i + 40], add_special_tokens=False), strict=True):
                        assert a.tolist() == e.ids
        else:
            assert not ChunkIds(path).merges  # another kind
    ids_of = ChunkIds(WORDS)
    ids_of.folds, ids_of.merges = False, None  # as of a tokenizer that keeps capitals
    for a, e in zip(ids_of.encode_list(texts), ids_of.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert a.tolist() == e.ids
    monkeypatch.setattr(tokens, "LONG", 100)
    monkeypatch.setattr(sets, "LONG", 100)
    long = " ".join(texts * 2)
    assert ids_of.encode_list([long])[0].tolist() == ids_of.tokenizer.encode(long, add_special_tokens=False).ids
    raw = np.frombuffer(long.encode(), np.uint8)
    cut = sets.word_hashes(raw)
    monkeypatch.setattr(sets, "LONG", 1 << 30)
    assert all((x == y).all() for x, y in zip(cut, sets.word_hashes(raw), strict=True))


def test_sentencepieces(spark):
    import sentencepiece

    lib, mine = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepieces.Pieces(PIECES, capacity=40)
    texts = [t or "" for t in ODD] + ["  two  spaces ", "Hello world, this is\n\na test of the_thing 😀", " ".join(words(random.Random(1), 90)), "internationalisation unbelievable " * 4]
    for t in texts:
        assert mine.encode(t).tolist() == lib.encode(t) and mine.decode(mine.encode(t)) == t
    r = random.Random(9)
    odd = ["".join(r.choice("ab é\n\n  日▁.\t\x0b" if k % 3 else "ab é\n  日.") for _ in range(r.randint(0, 50))) for k in range(400)]
    for most in (64_000_000, 2_000):  # the memo is emptied again and again
        mine = sentencepieces.Pieces(PIECES, 40, most)
        for i in range(0, len(odd), 50):
            raw = [t.encode() for t in texts + odd[i : i + 50]]
            ids, at = mine.encode_rows(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [lib.encode(t) for t in texts + odd[i : i + 50]]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts + [None])], "doc_id int, text string, ids int")
    for r in sentencepieces.decode(sentencepieces.encode(df, PIECES), PIECES).collect():
        assert r.decoded == (r.text or "")


def test_unigram_viterbi(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m, r = pb.ModelProto(), random.Random(3)
    with open(PIECES, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = sentencepieces.UNIGRAM
    for p in m.pieces:
        if p.type == 1:
            p.score = -1 - len(p.piece) * r.random() - 3 * r.random()
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(m.SerializeToString())
    lib, mine = sentencepiece.SentencePieceProcessor(model_file=path), sentencepieces.Pieces(path)
    for t in ["Hello world, this is a test", "abc 日本語 x", " ".join(words(r, 50)), "unbelievable internationalisation"]:
        assert mine.encode(t).tolist() == lib.encode(t)


def test_html():
    model = html_tree.train()
    sources = html_tree.labelled_pages(80, 991)
    pages = [html_tree.parse(s) for s in sources]
    y = np.concatenate([html_tree.known(p) for p in pages])
    p = np.exp(html_tree.sum_product(html_tree.forest(pages), *model)[0][:, 1]) > 0.5
    assert (p == y).mean() > 0.98
    page = '<html><body><nav><a href=/>x</a></nav><article><h1>A &amp; b</h1><p>One   two.<br>three</p><p><b>four<br><p>five &lt;six</article><div class="comments"><p>no</p></div><footer>&copy; z</footer>'
    assert html_tree.texts([page, None, "", "<p", "<script>var t='</p>'"], model) == ["A & b\nOne two. three\nfour\nfive <six", "", "", "", ""]


def test_sum_product_is_exact():
    f = html_tree.forest([html_tree.parse("<div class=ad><p>a<b>c</b></p><ul><li>x</ul></div>")])
    r = np.random.default_rng(0)
    w, e = r.normal(size=html_tree.N_FEATURES), r.normal(size=(html_tree.EDGES, 2, 2))
    n, total = len(f.parent), np.zeros((len(f.parent), 2))
    for m in range(2**n):
        v = [m >> i & 1 for i in range(n)]
        s = np.exp(sum(v[i] * (f.x[i] @ w) for i in range(n)) + sum(e[f.edge[i], v[f.parent[i]], v[i]] for i in range(n) if f.parent[i] >= 0))
        for i in range(n):
            total[i, v[i]] += s
    assert np.allclose(np.exp(html_tree.sum_product(f, w, e)[0]), total / total.sum(1, keepdims=True))


def test_marginals_are_exact():
    r = np.random.default_rng(4)
    sizes, switch = np.array([3, 1, 5, 2]), r.normal(size=(2, 2))
    s, at = r.normal(size=sizes.sum()), 0
    good, _ = quality_crf.marginals(s, sizes, switch)
    for n in sizes:
        total = np.zeros((n, 2))
        for m in range(2**n):
            v = [m >> i & 1 for i in range(n)]
            p = np.exp(sum(v[i] * s[at + i] for i in range(n)) + sum(switch[a, b] for a, b in zip(v, v[1:])))
            for i in range(n):
                total[i, v[i]] += p
        assert np.allclose(good[at : at + n], total[:, 1] / total.sum(1))
        at += n


def test_quality(spark):
    from loomtide.llm.queries import op3_quality

    got = {r.doc_id: r for r in op3_quality(spark, "/root/testdata/sf0.01").collect()}
    truth = [(r.doc_id, r.quality) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()]
    held = [(got[i].predicted, q) for i, q in truth if got[i].held_out]
    assert sum(p == q for p, q in held) >= 0.97 * len(held)


def test_quality_of_odd_texts(spark, corpus):
    rows, df = corpus
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = quality_crf.classify(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert quality_crf.classify(df.limit(0), labels.limit(0)).count() == 0


def test_rules(spark, corpus):
    rows, df = corpus
    assert quality_rules.counts("a b c a b c d\n\nx\nx\n #") == (10, 10, 1, 1, 6)
    got = quality_rules.host_rules(df).collect()
    assert len(got) == len(rows) and all(not (r.kept and r.base_failed) for r in got)
    wide = sorted(map(tuple, quality_rules.host_rules(df, broadcast_rows=0).collect()), key=str)
    assert wide == sorted(map(tuple, got), key=str)


def test_preferences(spark):
    turn = lambda *t: [dict(zip(("role", "text"), x)) for x in t]
    a = turn(("user", "q"), ("assistant", "one"), ("user", "r"), ("assistant", "two"))
    b = turn(("user", "q"), ("assistant", "one"), ("user", "s"), ("assistant", "three"))
    rows = spark.createDataFrame([(1, a, b, 0), (2, a, a, 0), (3, a, a[:2], 0), (4, None, b, 0), (5, None, None, 0)], "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt int")
    got = {r.pair_id: r for r in preference_format.preference_format(rows).collect()}
    assert [got[i].prompt_turns for i in range(1, 6)] == [2, 4, 2, 0, 0]
    assert got[1].prompt == "<|user|>\nq<|end|>\n<|assistant|>\none<|end|>\n" and got[2].chosen == got[2].rejected == got[3].rejected == ""
    (span,) = got[1].chosen_loss
    assert got[1].chosen[span.start : span.start + span.length] == "two<|end|>\n"


def test_empty_tables(corpus):
    _, df = corpus
    none = df.limit(0)
    for out in (exact_dedup.exact_dedup(none), jaccard_join.near_duplicates(none), substring_dedup.repeated_passages(none), packing.pack(none, WORDS), quality_rules.host_rules(none), training_order.materialise(none, WORDS), sentencepieces.encode(none, PIECES)):
        assert out.count() == 0
