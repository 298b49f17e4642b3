"""Connected components of a graph of rows by contraction, with pointer jumping; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import merged, removed, spread_join, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) for the nodes of edges (a, b).

    In a round each node points to its least neighbour, where that is less than itself; the trees of these pointers are
    contracted to their roots, and the edges between different roots, once each, are the next round's graph. At most half of
    a round's nodes are left, and edges within a tree are gone, so later rounds are small whatever the first graph is. A hub's
    edges, and the nodes under one root, are joined in parts. Every round's tables are written, and deleted once the next stand.
    Their files are many times smaller than their rows in memory, so Spark, which goes by files, must not choose to broadcast them: joins are by merge.
    """
    left = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    total = written(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("root", F.col("node")), "labels")
    for _ in range(most_rounds):
        if left.isEmpty():
            removed(left)
            return total
        roots = tree_roots(left.groupBy("b").agg(F.min("a").alias("least")).select(F.col("b").alias("a"), F.col("least").alias("b")))
        up = spread_join(left, merged(roots.select(F.col("node").alias("b"), F.col("root").alias("far"))), ["b"], ["a"]).select("a", F.col("far").alias("b"))
        up = written(up.where("a <> b").distinct(), "edges")
        near = spread_join(up, merged(roots.select(F.col("node").alias("a"), F.col("root").alias("far"))), ["a"], ["b"], "left").select(F.coalesce("far", "a").alias("a"), "b")
        new = written(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
        moved = spread_join(total, merged(roots.select(F.col("node").alias("root"), F.col("root").alias("far"))), ["root"], ["node"], "left").select("node", F.coalesce("far", "root").alias("root"))
        whole = written(moved, "labels")
        removed(left, up, total, roots)
        left, total = new, whole
    raise RuntimeError("components: edges are left")


def tree_roots(parents: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for the nodes a of a forest (a, b: its parent; one row each). Pointers are doubled, so rounds follow the logarithm of the depth, and only those that don't stand at a root yet go on."""
    now, settled = written(parents.select("a", "b"), "pointers"), []
    for _ in range(most_rounds):
        every = now
        for s in settled:
            every = every.unionByName(s)
        far = written(spread_join(now, merged(every.select(F.col("a").alias("b"), F.col("b").alias("far"))), ["b"], ["a"]).select("a", F.col("far").alias("b")), "pointers")
        if far.isEmpty():
            removed(far)
            out = written(every.select(F.col("a").alias("node"), F.col("b").alias("root")), "roots")
            removed(now, *settled)
            return out
        settled.append(written(now.join(merged(far.select("a")), "a", "left_anti"), "pointers"))
        removed(now)
        now = far
    raise RuntimeError("tree_roots: the parents make a ring")
