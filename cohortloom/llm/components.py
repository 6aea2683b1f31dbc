"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction over (a, b) with a > b: link neighbours to the least neighbour.

    The least neighbour is a map-side combined minimum that is joined back, so a node with
    very many neighbours is a skewed join, not a collected list.
    """
    if large:
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        moved = (around.join(least, "a").filter("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = (edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(least.select("a", F.col("m").alias("b"))))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the least node.

    Nodes without an edge, or with one to themselves only, have no row. Each round is
    checkpointed; the number of rounds grows with the logarithm of the longest path.
    """
    now = stored(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        now = stored(_star(_star(now, True), False))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
