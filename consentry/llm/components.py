"""Connected components by alternating stars, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from consentry.session import durable


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``: root is the smallest node that it is connected to.

    Each round links all larger neighbours of a node to its smallest neighbour, then all smaller ones; both steps keep the
    components and end, after a number of rounds that grows with the logarithm of the size, in one star per component.
    Neighbours are never gathered: their minimum is an aggregate, which is combined before the shuffle.
    """
    edges = durable(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct(), "edges")
    while True:
        # Large star: each neighbour that is larger than the node joins the smallest of the node and its neighbours.
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # Small star: the node and its smaller neighbours join the smallest of them.
        best = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(best, "hi").select(F.col("lo").alias("u"), "m").where("u > m")
        small = small.unionByName(best.select(F.col("hi").alias("u"), "m"))
        after = durable(small.select(F.col("u").alias("hi"), F.col("m").alias("lo")).distinct(), "edges")
        # Stars: no node that is a target has a target itself, and each has one.
        open_ends = after.groupBy("hi").agg(F.count("*").alias("n")).where("n > 1")
        chained = after.select("lo").distinct().join(after.select(F.col("hi").alias("lo")), "lo", "left_semi")
        if open_ends.isEmpty() and chained.isEmpty():
            break
        edges = after
    roots = after.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return after.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)
