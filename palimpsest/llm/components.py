"""Connected components of a table of edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """``node``, ``comp`` (the smallest node reachable) for each node of edges (a, b).

    In each step every node takes its smallest neighbour, if that is smaller, as its parent; parents are doubled until all
    are roots, so a chain of n nodes takes log2(n) rounds; edges are then renamed to roots and those inside one are
    dropped. At most half the nodes are left by a step. All of it is joins and grouped minima on written tables, so a node
    with very many edges is combined before the shuffle and split in the joins; tables go when the next one is written.

    Defined results: repeated edges and edges in both directions count once; a node with no edge but to itself is not in
    the result, nor is an edge with a null end; no edges give an empty result.
    """
    spark, n = edges.sparkSession, edges.count()
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    current, labels, step = common.cut(ordered, folder, f"{name}-edges", n), None, 0
    while not current.isEmpty():
        ends = current.select(F.col("a").alias("node"), F.col("b").alias("other")).union(current.select("b", "a"))
        up = common.cut(ends.groupBy("node").agg(F.least("node", F.min("other")).alias("up")), folder, f"{name}-up-{step}", 2 * n)
        turn, moved = 0, True
        while moved:
            over = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            doubled = up.select("node", "up").join(over, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved"))
            up, before = common.cut(doubled, folder, f"{name}-up-{step}-{turn}", 2 * n), f"{folder}/{name}-up-{step}" + (f"-{turn - 1}" if turn else "")
            moved = not up.filter("moved").isEmpty()
            common.remove(spark, before)
            turn += 1
        if labels is None:
            labels = up.select("node", F.col("up").alias("comp"))
        else:
            over = up.select(F.col("node").alias("comp"), "up")
            labels = common.cut(labels.join(over, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")), folder, f"{name}-labels-{step}", 2 * n)
        left = up.select(F.col("node").alias("a"), F.col("up").alias("x"))
        right = up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        joined = current.join(left, "a").join(right, "b").filter("x <> y")
        current = common.cut(joined.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), folder, f"{name}-edges-{step}", n)
        step += 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).limit(0)
    return labels
