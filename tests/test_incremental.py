"""What is kept over epochs: streams with a state, restarts, inputs and subscriptions, loops maintained under changes."""

import random

from pyspark.sql import functions as F

from loomtide import streaming
from loomtide.operators import epochs, loops
from loomtide.operators.zset import ZSet
from loomtide.plans import programs


def feed(spark, schema, parts, build, mode="append"):
    out, source = [], streaming.Input(spark, schema)
    source.subscribe(lambda rows, e: out.append((e, sorted(map(tuple, rows.collect())))), build, mode)
    for part in parts:
        source.on_next(spark.createDataFrame(part, schema) if part else None)
    return out


def test_lookups_keep_types(spark):
    parts = [[("a", 9, False), ("a", 10, False), ("b", None, False)], [("a", None, True), ("b", None, True), ("c", None, True)], [("a", 2, False), ("a", None, True), ("a", None, True)]]
    got = feed(spark, "k string, v int, is_get boolean", parts, lambda r: streaming.lookups(r, "k", "v", F.col("is_get")))
    assert got == [(0, []), (1, [("a", 10)]), (2, [("a", 2), ("a", 2)])]


def test_states_over_epochs(spark):
    parts = [[(1, 5.0), (1, 3.0), (2, 7.0)], [], [(1, 4.0), (2, 6.0)], [(1, 3.0), (3, None)]]
    got = feed(spark, "k long, v double", parts, lambda r: streaming.blocking_aggregate(r, "k", "v"))
    assert got == [(0, [(1, 3.0), (2, 7.0)]), (1, []), (2, [(2, 6.0)]), (3, [])]
    got = feed(spark, "k long, v double", parts, lambda r: streaming.distinct(r, "k"))
    assert got == [(0, [(1,), (2,)]), (1, []), (2, []), (3, [(3,)])]
    got = feed(spark, "k long, v double", [[(1, 5.0)], [(1, 4.0)]], lambda r: streaming.streaming_aggregate(r, "k", "v", max))
    assert got == [(0, [(1, 5.0)]), (1, [])]


def test_changes_go_on_after_a_restart(spark, tmp_path):
    for keys in (None, ["w"]):
        folder, seen = str(tmp_path / f"keyed-{bool(keys)}"), {}

        def run():
            stream = spark.readStream.schema("w string").parquet(f"{folder}/in")
            streaming.changes(stream, lambda z: z.count("w"), lambda d, e: seen.setdefault(e, []).append(sorted((r.w, r.n, r.weight) for r in d.collect())), f"{folder}/checkpoint", keys, fold=2).awaitTermination()  # noqa: B023

        for part in (["a", "a"], ["a", "b"], ["b"], ["c", "a"]):
            spark.createDataFrame([(x,) for x in part], "w string").write.mode("append").parquet(f"{folder}/in")
            run()
        assert [x for e in sorted(seen) for x in seen[e]] == [[("a", 2, 1)], [("a", 2, -1), ("a", 3, 1), ("b", 1, 1)], [("b", 1, -1), ("b", 2, 1)], [("a", 3, -1), ("a", 4, 1), ("c", 1, 1)]]


def test_inputs(spark):
    source, told, moved, ended = streaming.Input(spark, "v long"), [], [], []
    source.on_frontier(moved.append)
    first = source.subscribe(lambda rows, e: told.append((e, rows.count())), on_completed=lambda: ended.append(1))
    gate = streaming.StreamingInput(source)
    one = lambda n: spark.range(n).withColumnRenamed("id", "v")
    for rows, epoch in ((3, 2), (1, 0), (2, 2)):
        gate.on_recv(one(rows), epoch)
    gate.on_notify(1)
    gate.on_recv(one(4), 1)
    gate.on_notify(2)
    first.sync(2)
    source.on_completed()
    assert told == [(0, 1), (1, 0), (2, 5)] and gate.late == 4 and moved == [1, 2, 3, None] and ended == [1]
    again = []
    source.subscribe(lambda rows, e: again.append((e, rows.count())))
    assert again == told
    for bad in (lambda: source.on_next(one(1)), lambda: first.sync(3)):
        try:
            bad()
        except ValueError:
            continue
        raise AssertionError


def test_loops_under_changes(spark):
    r = random.Random(11)
    nodes = list(range(24))
    edges = {(r.choice(nodes), r.choice(nodes)) for _ in range(30)}
    values = spark.createDataFrame([(n, (n * 7) % 24) for n in nodes], "node long, value long")
    df = lambda e: spark.createDataFrame(sorted(e), "src long, dst long")

    def want(e):
        best = {n: (n * 7) % 24 for n in nodes}
        for _ in nodes:
            for a, b in e:
                best[b] = min(best[b], best[a])
        return best

    best = loops.propagate_min(values, df(edges))
    for _ in range(3):
        assert {x.node: x.value for x in best.collect()} == want(edges)
        gone, new = set(r.sample(sorted(edges), 6)), {(r.choice(nodes), r.choice(nodes)) for _ in range(6)} - edges
        best = loops.propagate_min_again(best, values, df(edges), df(new), df(gone))
        edges = edges - gone | new
    assert {x.node: x.value for x in best.collect()} == want(edges)


def test_long_paths_need_no_limit(spark):
    chain = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert programs.reachable(chain, spark.createDataFrame([(0,)], "node long")).count() == 41
    before = programs.connected_components(chain)
    cut = spark.createDataFrame([(20, 21)], "src long, dst long")
    after = programs.components_again(before, chain, spark.createDataFrame([(99, 30)], "src long, dst long"), cut)
    assert {x.component for x in after.collect() if x.node > 20} == {21} and after.filter("component = 0").count() == 21


def test_leaving_a_loop(spark):
    one = spark.createDataFrame([(1,)], "v long")
    double = lambda d: d.select((F.col("v") * 2).alias("v"))
    assert sorted(x.v for x in loops.exit_loop(loops.iterates(one, double, 3, partition="v"), 2).collect()) == [8, 16]
    assert loops.exit_loop(loops.iterates(one, lambda d: d.limit(0), 5), 3).count() == 0


def test_two_inputs_and_units(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, p string"), spark.createDataFrame([(2, 5.0), (3, 6.0)], "j int, q double")

    def f(parts):
        import pandas as pd

        for rows in parts:
            yield pd.DataFrame({"n": [int((rows["#side"] == 0).sum())], "m": [int((rows["#side"] == 1).sum())]})

    got = epochs.binary_expression(a, b, ["k"], ["j"], f, "n int, m int").collect()
    assert sum(x.n for x in got) == 2 and sum(x.m for x in got) == 2
    z = ZSet(spark.createDataFrame([("a", 2_500_000), ("b", 0), ("c", -3), ("d", 1)], "k string, weight long"))
    assert {x.k: x["count"] for x in z.expanded().groupBy("k").count().collect()} == {"a": 2_500_000, "d": 1}
    grouped = z.group_weighted("k", lambda rows: rows.assign(n=rows["weight"]), "k string, weight long, n long").df.collect()
    assert {x.k: x.n for x in grouped} == {"a": 2_500_000, "d": 1}
