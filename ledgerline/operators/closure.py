"""What a group inherits: transitive closure over parents in depth-first order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.session import drop_stored, small_or_shuffled, stored

_LAST = 2**31 - 1


def inherited(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, node, place, depth): every group that a root reaches, itself included, once.

    edges: (child, parent, k), k the parent's place. place orders nodes as a depth-first walk leaves
    them, parents before the group itself. A node reached by several ways counts at its first; cycles
    are cut. The frontier is one table a step, thinned to the first way to each node before it is
    joined again, so ways don't multiply in a graph whose branches meet.
    """
    start = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.array().cast("array<int>").alias("way"), F.array(F.col("id")).alias("trail"))
    edges = small_or_shuffled(stored(edges.select(F.col("child").alias("node"), "parent", "k"), "parents"))
    frontier, all_ = stored(start, "frontier"), []
    while not frontier.isEmpty():
        all_.append(frontier)
        step = frontier.join(edges, "node").where(~F.array_contains("trail", F.col("parent")))
        step = step.select("root", F.col("parent").alias("node"), F.concat("way", F.array("k")).alias("way"), F.concat("trail", F.array("parent")).alias("trail"))
        first = step.groupBy("root", "node").agg(F.min(F.struct("way", "trail")).alias("w"))
        frontier = stored(first.select("root", "node", "w.way", "w.trail"), "frontier")
    drop_stored(frontier)
    if not all_:
        return start.select("root", "node", F.col("way").alias("place"), F.lit(0).alias("depth"))
    found = reduce(DataFrame.unionByName, all_).groupBy("root", "node").agg(F.min("way").alias("way"))
    return found.select("root", "node", F.concat("way", F.array(F.lit(_LAST))).alias("place"), F.size("way").alias("depth"))
