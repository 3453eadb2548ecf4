"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import drop_stored, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs -> (node, root): root is one fixed member of the node's component.

    Each round orders the vertices by a fresh hash, sends every vertex to the first of its closed
    neighbourhood and contracts the graph; in expectation a round removes a constant share of the
    vertices of every component that has an edge left, long chains included.
    Edges and the round's mapping are stored, so a lost executor costs one round at most, and both
    sides of each join are plain shuffles, which adaptive execution splits where a hub is hot.
    Self-loops and repeated edges are allowed; nulls are not.
    """
    live = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mapping, turn = None, 0
    while not live.isEmpty():
        ends = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda name, turn=turn: F.struct(F.xxhash64(name, F.lit(turn)).alias("h"), F.col(name).alias("id"))
        first = ends.groupBy("a").agg(F.min(rank("b")).alias("n")).select(F.col("a").alias("node"), F.least("n", rank("a")).alias("n"))
        step = stored(first.select("node", F.col("n.id").alias("to")), "step")
        left = live.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
        both = left.join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        kept = both.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        after = stored(kept, "edges")
        if mapping is None:
            mapping = step.select("node", F.col("to").alias("root"))
        else:
            moved = mapping.join(step.select(F.col("node").alias("root"), "to"), "root", "left")
            mapping = stored(moved.select("node", F.coalesce("to", "root").alias("root")), "roots")
        drop_stored(live)
        live, turn = after, turn + 1
    drop_stored(live)
    if mapping is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return mapping
