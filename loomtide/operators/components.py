"""Connected components by contraction, all steps distributed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (a[i], b[i]), sorted, and the smallest node that links reach from each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (jumped := root[root] != root).any():
            root[jumped] = root[root[jumped]]
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[root]


def at_driver(edges: DataFrame) -> DataFrame:
    """node, root of few edges (a, b): one small table instead of rounds of joins, each of which costs as much as its tasks take to start."""
    import pyarrow as pa

    got = edges.toArrow()
    node, root = roots(got.column("a").to_numpy(), got.column("b").to_numpy())
    return stage(edges.sparkSession.createDataFrame(pa.table({"node": node, "root": root})), "hooks")


def components(links: DataFrame, finish: int = 0) -> DataFrame:
    """node, component (smallest node that links reach) for every node of links (a, b: long, not null).

    Each round hooks every component to its smallest neighbour if that is smaller, follows the hooks to their end, and renames the
    links; a round at least halves the components that still have links between them. A component with very many links is reduced to
    one row a neighbour before it is shuffled. Once at most `finish` links are left, the driver follows them (16 bytes each).
    """
    edges = stage(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label: DataFrame | None = None
    while n := edges.count():
        both = edges.union(edges.select("b", "a"))
        if n <= finish:
            hook = at_driver(edges)
        else:
            hook = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "hooks")
        while n > finish:  # every step doubles the length of the paths that are followed
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = stage(hook.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "hooks")
            hook = jumped.select("node", "root")
            if jumped.filter("moved").isEmpty():
                break
        if label is None:
            label = hook.select("node", F.col("root").alias("component"))
        else:
            named = hook.select(F.col("node").alias("component"), "root")
            label = stage(label.join(named, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
        if n <= finish:
            break
        x, y = hook.select(F.col("node").alias("a"), F.col("root").alias("ra")), hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = stage(edges.join(x, "a").join(y, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if label is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    return label
