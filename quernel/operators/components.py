"""Connected components of an edge table, without gathering any component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.workspace import drop_staged, stage


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(src, dst)`` of longs or strings -> ``(node, component)``, component = smallest node reachable.

    By contraction: every node points to its smallest neighbour if that is smaller (a map-side
    combined ``min``), pointers jump once, and edges are moved to what their ends point to. Edges
    within a group are gone after the first round or two, so the edge table is read once at full
    size, and rounds grow with the logarithm of the longest chain. Nodes without an edge don't
    appear; self-loops and repeated edges are harmless; rows with a null end are ignored. Each
    round is written to the shared folder, so a lost executor costs one round at most.
    """
    ends = edges.where("src IS NOT NULL AND dst IS NOT NULL").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    rest = stage(ends.distinct(), "links")
    placed = stage(rest.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("component", F.col("node")), "placed")
    for _ in range(max_rounds):
        if rest.where("src <> dst").isEmpty():
            drop_staged(rest)
            return placed
        # The larger end of an edge may point to the smaller one; the smaller one never points up.
        parent = stage(rest.where("src <> dst").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent")), "parents")
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = stage(parent.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent")), "parents")
        a = rest.join(jumped.withColumnRenamed("node", "src"), "src", "left").select(F.coalesce("parent", "src").alias("a"), "dst")
        b = a.join(jumped.withColumnRenamed("node", "dst"), "dst", "left").select("a", F.coalesce("parent", "dst").alias("b"))
        moved = stage(b.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "links")
        onward = stage(placed.join(jumped.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "placed")
        for done in (rest, placed, parent, jumped):
            drop_staged(done)
        rest, placed = moved, onward
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
