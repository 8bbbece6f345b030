"""Multisets, epochs, loops, graphs, programs and streams against hand-computed or brute-force results."""

import random

import pytest
from pyspark.sql import functions as F

from loomtide import sources, streaming
from loomtide.functions import mex
from loomtide.operators import epochs, graph, incremental, loops
from loomtide.operators.zset import ZSet
from loomtide.plans import programs

A, B = {"a": 2, "b": 1, "c": -1}, {"a": 1, "b": 3, "d": 1}


def zset(spark, w):
    return ZSet(spark.createDataFrame(list(w.items()), "k string, weight long"))


def net(z):
    return {r.k: r.weight for r in z.consolidate().df.collect()}


@pytest.mark.parametrize(("op", "want"), [
    (lambda a, b: a.concat(b), {"a": 3, "b": 4, "c": -1, "d": 1}), (lambda a, b: a.except_(b), {"a": 1, "b": -2, "c": -1, "d": -1}), (lambda a, b: a.union(b), {"a": 2, "b": 3, "d": 1}),
    (lambda a, b: a.intersect(b), {"a": 1, "b": 1, "c": -1}), (lambda a, b: a.symmetric_difference(b), {"a": 1, "b": 2, "c": 1, "d": 1}), (lambda a, b: a.distinct(), {"a": 1, "b": 1}), (lambda a, b: a.abs(), {"a": 2, "b": 1, "c": 1}),
])
def test_weights(spark, op, want):
    assert net(op(zset(spark, A), zset(spark, B))) == want


def test_keyed(spark):
    z = ZSet(spark.createDataFrame([("x", 3, 2), ("x", 1, 1), ("x", 1, -1), ("y", 0, 1), ("z", 5, -1), (None, 7, 1)], "k string, v int, weight long"))
    assert {r.k: r.n for r in z.count("k").df.collect()} == {"x": 2, "y": 1, None: 1}
    assert {r.k: r.total for r in z.sum("k", "v").df.collect()} == {"x": 6, "y": 0, "z": -5, None: 7}
    assert {r.k: r.v for r in z.min("k", "v").df.collect()} == {"x": 3, "y": 0, None: 7}
    assert sorted(r.v for r in z.expanded().collect()) == [0, 3, 3, 7]
    assert z.join(z, "k", "k", "l.k").consolidate().df.filter("k IS NULL").first().weight == 1


def test_changes_of_results(spark):
    r = random.Random(1)
    make = lambda n: ZSet(spark.createDataFrame([(r.randrange(4), r.randrange(3), r.choice([1, 1, 2, -1])) for _ in range(n)], "k int, v int, weight long"))
    a, da, b, db = make(12), make(4), make(12), make(4)
    rows = lambda z: sorted(map(tuple, z.consolidate().df.select(sorted(z.df.columns)).collect()))
    for op in (lambda z: z.count("k"), lambda z: z.min("k", "v"), lambda z: z.distinct(), lambda z: z.sum("k", "v")):
        assert rows(incremental.keyed_delta(a, da, ["k"], op)) == rows(op(a.concat(da)).except_(op(a)))
    on = ("k", "k", F.col("l.k").alias("k"), F.col("r.v").alias("v"))
    assert rows(incremental.join_delta(a, da, b, db, *on)) == rows(a.concat(da).join(b.concat(db), *on).except_(a.join(b, *on)))
    log = incremental.DeltaLog(a, keep=2)
    for d in (da, None, db):
        log.on_next(d)
    assert log.epoch == 2 and rows(log.state()) == rows(a.concat(da).concat(db))


def test_windows_and_lookups(spark):
    e = spark.createDataFrame([(0, "p"), (0, "p"), (1, "q"), (4, "p")], "epoch long, k string")
    z = ZSet.of(e).sliding_window(2)
    for until in range(7):
        have = {r.k: r.weight for r in z.accumulated(until).df.collect()}
        want = {r.k: r.n for r in epochs.sliding_counts(e, ["k"], 2).filter(F.col("epoch") == until).collect()}
        assert have == want
    puts = spark.createDataFrame([(0, "a", 1), (2, "a", 5), (2, "a", 4)], "epoch long, k string, v int")
    gets = spark.createDataFrame([(0, "a"), (1, "a"), (2, "a"), (1, "b")], "epoch long, k string")
    assert sorted((r.epoch, r.v) for r in epochs.lookup(puts, gets, "k", "v").collect()) == [(0, 1), (1, 1), (2, 5)]


def test_loops(spark):
    one = spark.createDataFrame([(1,), (2,)], "v long")
    double = lambda d: d.select((F.col("v") * 2).alias("v"))
    assert sorted(r.v for r in loops.iterate(one, double, 2).collect()) == [8, 16]
    assert sorted(r.v for r in loops.iterate(one, double, 2, F.col("v") - 1).collect()) == [8, 8]
    assert sorted(r.v for r in loops.iterate_and_accumulate(one, double, 1).collect()) == [2, 4, 4, 8]
    with pytest.raises(RuntimeError):
        loops.fixed_point(ZSet.of(one), lambda z: z.select((F.col("v") + 1).alias("v")), 2)


def test_graph_programs(spark):
    r = random.Random(0)
    pairs = [(r.randrange(30), r.randrange(30)) for _ in range(40)]
    edges, nodes = spark.createDataFrame(pairs, "src long, dst long"), {x for p in pairs for x in p}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            reach[a] |= reach[b]
    assert {(x.src, x.dst) for x in programs.strongly_connected(edges).collect()} == {(a, b) for a, b in pairs if a in reach[b]}
    assert {x.node: x.value for x in programs.directed_reach(edges).collect()} == {n: min(m for m in nodes if n in reach[m]) for n in nodes}
    color = {}
    for n in sorted(nodes):
        used = {color[m] for a, b in pairs for m, o in ((a, b), (b, a)) if o == n and m < n}
        color[n] = next(c for c in range(99) if c not in used)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert {x.node: x.color for x in programs.coloring(edges).collect()} == {n: c for n, c in color.items() if n in linked}
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert {x.node: x.component for x in programs.connected_components(edges).collect()} == root


def test_names_and_machines(spark):
    e = spark.createDataFrame([("x", "y"), ("y", "z"), ("x", "y")], "src string, dst string").repartition(3)
    names = graph.AutoRenamer().add(e, "src", "dst").final()
    assert sorted(r.node for r in names.collect()) == [0, 1, 2]
    assert graph.rename_edges(e, names).count() == 3
    states = spark.createDataFrame([(1, 5), (2, 7)], "node long, state long")
    values = spark.createDataFrame([(1, 3), (1, 9), (3, 1)], "node long, value long")
    new, out = graph.state_machine(values, states, F.max, F.greatest("state", "value"))
    assert {r.node: r.state for r in new.collect()} == {1: 9, 2: 7, 3: 1} and {r.node: r.value for r in out.collect()} == {1: 9, 3: 1}
    assert spark.range(1).select(mex(F.array(F.lit(0), F.lit(1), F.lit(3)))).first()[0] == 2


def test_states_of_all_epochs(spark):
    from loomtide.plans.queries import QUERIES

    sf, want = "/root/testdata/sf0.001", {}
    for r in spark.read.parquet(f"{sf}/events.parquet").collect():
        want[r.user_id] = max(r.value, want.get(r.user_id, r.value))
    assert {r.node: r.state for r in QUERIES["state_machine_all"](spark, sf).collect()} == want


def test_learning(spark):
    x = [[0.0, 1.0], [0.2, 0.8], [5.0, 5.0], [5.5, 4.5]]
    got = {r.cluster: (r.n, r["mean"]) for r in programs.k_means(spark.createDataFrame([(v,) for v in x], "x array<double>"), [[0, 0], [6, 6], [99, 99]], 3).collect()}
    assert got[0] == (2, [0.1, 0.9]) and got[1] == (2, [5.25, 4.75]) and got[2] == (0, [99.0, 99.0])
    w = programs.logistic_regression(spark.createDataFrame([(1, [1.0, 0.0]), (-1, [-1.0, 0.5])], "y int, x array<double>"), 2, 1).collect()
    assert [r.weight for r in w] == [-1.0, 0.25]


def test_learning_from_whole_vectors(spark):
    import numpy as np

    from loomtide.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x, y = np.array([r.embedding for r in rows], float), np.array([1 if r.label % 2 == 0 else -1 for r in rows])
    means, w = np.array([[-1.0] * x.shape[1], [1.0] * x.shape[1]]), np.zeros(x.shape[1])
    for _ in range(5):
        near = ((x[:, None] - means) ** 2).sum(2).argmin(1)
        means = np.array([x[near == c].mean(0) if (near == c).any() else m for c, m in enumerate(means)])
        w = w + 0.01 * ((y / (1 + np.exp(y * (x @ w)))) @ x)
    got = {(r.cluster, r.j): r for r in QUERIES["k_means"](spark, sf).collect()}
    assert len(got) == means.size and all(abs(got[c, j]["mean"] - means[c, j]) < 1e-5 and got[c, j].n == (near == c).sum() for c in (0, 1) for j in range(means.shape[1]))
    weights = {r.j: r.weight for r in QUERIES["logistic_regression"](spark, sf).collect()}
    assert np.allclose([weights[j] for j in range(x.shape[1])], w, atol=1e-5) and len(weights) == x.shape[1]


def test_files_and_streams(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# c\n1 2\n3\t4")
    assert sorted((r.src, r.dst) for r in sources.read_edges(spark, [str(tmp_path / "e.txt")] * 2).collect()) == [(1, 2), (3, 4)]
    b = sources.batches(spark, [["a", "b"], [], ["a"]], "w string")
    sources.write_by_epoch(b, str(tmp_path / "by"))
    assert sorted((r.epoch, r.w) for r in spark.read.parquet(str(tmp_path / "by")).collect()) == [(0, "a"), (0, "b"), (2, "a")]
    assert sources.read_binary(spark, str(tmp_path / "e.txt"), lambda c: [(len(c),)], "n long").first().n == 11
    for i, w in enumerate((["a", "b"], ["a"])):
        spark.createDataFrame([(x,) for x in w], "w string").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    seen = []
    stream = streaming.epochs_of_files(spark, str(tmp_path / "in/*"), "w string")
    streaming.changes(stream, lambda z: z.count("w"), lambda d, e: seen.append({(r.w, r.n): r.weight for r in d.collect()})).awaitTermination()
    total = {}
    for s in seen:
        for k, w in s.items():
            total[k] = total.get(k, 0) + w
    assert {k for k, w in total.items() if w} == {("a", 2), ("b", 1)}
