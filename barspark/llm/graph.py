"""Connected components of links, on the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one link a node with the same components: (node, smallest node of its component) of the given links."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new != (jump := new[new])).any():
            new = jump
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def components(links: DataFrame) -> DataFrame:
    """``a, b`` (long) -> ``node, root``: root is the smallest node that links reach. Only linked nodes are returned.

    Large-star and small-star rounds until the links stay as they are; each round's links are written to the shared
    folder, so that the plan doesn't grow and lost executors cost no more than one round. Self links count for nothing.
    """

    made: list[DataFrame] = []

    def star(edges: DataFrame, small: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if not small:
            both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # written, so that the join reads two exchanges and Spark can split the links of one large star
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        made.append(least)
        side = both if small else both.where("v > u")
        out = side.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        if small:
            out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    sign = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = stored(edges, "links"), None
    seen = tuple(now.agg(*sign).first())
    while seen != before:
        before = seen
        large = stored(star(now, small=False), "links")
        after = stored(star(large, small=True), "links")
        for old in (now, large, *made):
            dropped(old)
        made.clear()
        now, seen = after, tuple(after.agg(*sign).first())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
