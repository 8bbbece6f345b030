"""Whole programs: word counts, search, graphs, clustering and regression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dot, mex, squared_distance, words
from ..operators import graph
from ..operators.components import components
from ..operators.loops import fixed_point, iterate_and_accumulate, propagate_min, propagate_min_again
from ..operators.staging import stage
from ..operators.zset import ZSet


#: Terms of queries, a few dozen bytes each, that are broadcast at most.
SEARCHED = 500_000


def word_counts(lines: ZSet, text: str) -> ZSet:
    return lines.select_many(words(F.col(text)), "word").count("word")


def search(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(doc, query, n) of docs (id, text) and queries (id, text, threshold): n distinct terms in common, at least the threshold.

    Up to SEARCHED terms of queries are broadcast: then documents' other terms go where they are read, and pairs are counted in the
    same task, so that no frequent term is a hot key. More are joined by term.
    """
    terms = lambda df, name, *more: df.select(F.col("id").alias(name), *more, F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    asked = stage(terms(queries, "query", "threshold"), "asked")
    if asked.limit(SEARCHED + 1).count() <= SEARCHED:
        asked = F.broadcast(asked)
    both = terms(docs, "doc").join(asked, "term")
    return both.groupBy("doc", "query", "threshold").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= F.col("threshold")).select("doc", "query", "n")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each component."""
    links = stage(edges.select(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b")), "links")
    alone = links.filter("a = b").select(F.col("a").alias("node")).distinct()
    found = components(links)
    return found.unionByName(alone.join(found, "node", "left_anti").withColumn("component", F.col("node")))


def component_sizes(edges: DataFrame) -> DataFrame:
    """(size, n): how many components have a size."""
    return connected_components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n"))


def directed_reach(edges: DataFrame) -> DataFrame:
    """(node, value): the least node from which each node can be reached along edges, itself included."""
    edges = stage(edges.select("src", "dst").distinct(), "edges")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return propagate_min(nodes.withColumn("value", F.col("node")), edges)


def components_again(components: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """connected_components(edges + added - removed) from that of edges, both ways of each edge included: only components that change are computed.

    Nodes that have no edge any more are components of their own.
    """
    both = lambda e: e.select("src", "dst").union(e.select("dst", "src")).distinct()
    nodes = components.select("node").union(added.select("src")).union(added.select("dst")).distinct()
    best = components.select("node", F.col("component").alias("value"))
    return propagate_min_again(best, nodes.withColumn("value", F.col("node")), both(edges), both(added), both(removed)).select("node", F.col("value").alias("component"))


def named_reach(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Names (name) that the roots (name) reach along edges of names (src, dst), roots included: names become dense numbers, and numbers names again."""
    names = stage(graph.AutoRenamer().add(edges, "src", "dst").add(roots, "name").final(), "names")
    found = reachable(graph.rename_edges(edges, names), graph.rename_nodes(roots, names))
    return found.join(names, "node").select("name")


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that roots (node) reach, roots included."""
    edges = stage(edges.select("src", "dst").distinct(), "edges")
    return propagate_min(roots.select("node", F.lit(0).alias("value")), edges).select("node")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose source has an edge coming in, over and over."""

    def step(e: ZSet) -> ZSet:
        return ZSet(e.df.join(e.df.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst", "weight"))

    return fixed_point(ZSet.of(edges), step).df.select("src", "dst")


def _cut(edges: DataFrame) -> DataFrame:
    """Edges both of whose ends have the same least node that reaches them."""
    label = directed_reach(edges)
    ends = edges.join(label.select(F.col("node").alias("src"), F.col("value").alias("l1")), "src").join(label.select(F.col("node").alias("dst"), F.col("value").alias("l2")), "dst")
    return ends.filter("l1 = l2").select("src", "dst")


def strongly_connected(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) within strongly connected components."""
    turn = lambda e: e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    start = turn(_trimmed(turn(_trimmed(edges.select("src", "dst").distinct()))))
    return fixed_point(ZSet.of(start), lambda z: ZSet.of(turn(_cut(turn(_cut(z.df.select("src", "dst"))))))).df.select("src", "dst")


def coloring(edges: DataFrame) -> DataFrame:
    """(node, color): each node, in order of its number, has the least color that no smaller neighbour has. A round colors all nodes whose smaller neighbours have colors."""
    pairs = stage(edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    nodes = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()
    colors = stage(nodes.withColumn("color", F.lit(None).cast("int")), "colors")
    while True:
        below = pairs.join(colors.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.collect_set("color").alias("used"), F.count_if(F.col("color").isNull()).alias("unset"))
        told = colors.join(below, "node", "left")
        color = F.when(F.col("color").isNotNull(), F.col("color")).when(F.coalesce("unset", F.lit(0)) == 0, mex(F.coalesce("used", F.array().cast("array<int>"))))
        colors = stage(told.select("node", color.alias("color")), "colors")
        if colors.filter("color IS NULL").isEmpty():
            return colors


def pagerank(edges: DataFrame, iterations: int = 10, reset: float = 0.15) -> DataFrame:
    """(node, value): ranks that start at `reset` for nodes with edges going out, sent on in iterations + 1 steps and summed; not normalised."""
    edges = edges.select("src", "dst")
    degrees = graph.count_nodes(edges.select(F.col("src").alias("node"))).withColumnRenamed("value", "state")
    edges = stage(edges.join(degrees.withColumnRenamed("node", "src"), "src"), "edges")  # with the source's degree: one join a step
    start = stage(degrees.select("node", F.lit(reset).alias("value")), "start")

    def step(ranks: DataFrame) -> DataFrame:
        return graph.graph_reduce(ranks, edges, value=F.col("value") * (1 - reset) / F.col("state")).filter("value > 0")

    return graph.node_aggregate(iterate_and_accumulate(start, step, iterations).unionByName(start)).filter("value > 0")


def k_means(samples: DataFrame, start: list[list[float]], iterations: int = 10) -> DataFrame:
    """(cluster, n, mean) after some steps; samples: x, an array. Ties go to the first mean; a cluster without samples keeps its mean."""
    means = [list(map(float, m)) for m in start]
    d = len(means[0])
    for i in range(iterations):
        near = F.array(*(F.struct(squared_distance(F.col("x"), F.array(*map(F.lit, m))).alias("d"), F.lit(c).alias("c")) for c, m in enumerate(means)))
        got = samples.select(F.array_min(near)["c"].alias("cluster"), "x").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("x")[j].cast("double")).alias(f"s{j}") for j in range(d))).collect()  # one row for each mean
        counts = {r["cluster"]: r["n"] for r in got}
        for r in got:
            means[r["cluster"]] = [r[f"s{j}"] / r["n"] for j in range(d)]
    spark = samples.sparkSession
    return spark.createDataFrame([(c, counts.get(c, 0) if iterations else 0, m) for c, m in enumerate(means)], "cluster int, n long, mean array<double>")


def logistic_regression(samples: DataFrame, dimensions: int, iterations: int = 10, step: str | float = "replace") -> DataFrame:
    """(j, weight) after some steps; samples: y (1 or -1) and x, an array. step: a rate, or "replace": the weights become the gradient."""
    w = [0.0] * dimensions
    for _ in range(iterations):
        margin = F.col("y") * dot(F.col("x"), F.array(*map(F.lit, w)))
        pull = (1 / (1 + F.exp(margin))) if step != "replace" else (1 / (1 + F.exp(margin)) - 1)
        g = samples.select((pull * F.col("y")).alias("p"), "x").agg(*(F.sum(F.col("p") * F.col("x")[j]).alias(f"g{j}") for j in range(dimensions))).first()
        w = [g[j] or 0.0 for j in range(dimensions)] if step == "replace" else [a + step * (g[j] or 0.0) for j, a in enumerate(w)]
    return samples.sparkSession.createDataFrame(list(enumerate(w)), "j int, weight double")
