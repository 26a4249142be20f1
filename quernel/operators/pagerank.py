"""Personalised PageRank over the undirected multigraph, and memories scored by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.text import nocase
from quernel.operators.graph import adjacency
from quernel.operators.temporal import current
from quernel.workspace import drop_staged, stage

STAGE_EVERY = 5


def _weight(col: str = "weight"):
    return F.when(F.coalesce(F.col(col), F.lit(0.0)) == 0, 1.0).otherwise(F.col(col).cast("double"))


def personalized_pagerank(edges: DataFrame, seeds: list[str], damping: float = 0.85, iterations: int = 10, include_historical: bool = False) -> DataFrame:
    """``(node, score)`` of the nodes with a score over 0, names in full lower case.

    Exactly ``iterations`` synchronous rounds from the uniform vector; damping is held in
    [0.01, 0.99]. Parallel edges all count and a loop counts twice; weights of 0 or null are 1.
    Seeds that no edge touches don't take part; if none takes part each seed gets 1 / seeds and
    nothing moves; without edges the result is empty. Seeds that differ in case lose a share.

    The edges are read once and laid out for both ends; the normalised adjacency is written, and
    every round is one join and one map-side combined sum by target node, which splits hubs among
    all tasks.
    """
    spark = edges.sparkSession
    damping = min(0.99, max(0.01, damping))
    kept = current(edges, include_historical).select(F.lower("source").alias("s"), F.lower("target").alias("t"), _weight().alias("w"))
    ends = F.explode(F.array(F.struct(F.col("s").alias("node"), F.col("t").alias("other")), F.struct(F.col("t").alias("node"), F.col("s").alias("other"))))
    # Parallel edges are one from here on: their shares add up.
    both = stage(kept.select(ends.alias("e"), "w").groupBy("e.node", "e.other").agg(F.sum("w").alias("w")), "pagerank")
    nodes = stage(both.groupBy("node").agg(F.sum("w").alias("out")), "pagerank-nodes")
    n = nodes.count()
    names = [s.lower() for s in seeds]
    schema = "node string, score double"
    if n == 0 or not names:
        return spark.createDataFrame([], schema)
    active = [r.node for r in nodes.where(F.col("node").isin(names)).collect()]
    listed = [s for s in names if s in active]
    if not listed:
        return spark.createDataFrame([(s, 1.0 / len(names)) for s in dict.fromkeys(names)], schema)
    teleport = F.when(F.col("node").isin(active), (1 - damping) / len(listed)).otherwise(0.0)
    scores = nodes.select("node", F.lit(1.0 / n).alias("score"))
    adj, steps = stage(both.join(nodes, "node").select("node", "other", (F.col("w") / F.col("out")).alias("share")), "pagerank"), []
    drop_staged(both)
    for i in range(1, iterations + 1):
        moved = scores.join(adj, "node").groupBy(F.col("other").alias("node")).agg(F.sum(F.col("score") * F.col("share")).alias("in"))
        scores = moved.select("node", (teleport + damping * F.col("in")).alias("score"))  # every node has a neighbour
        if i % STAGE_EVERY == 0:
            steps.append(stage(scores, "pagerank-scores"))
            scores = steps[-1]
    if iterations % STAGE_EVERY:
        scores = stage(scores, "pagerank-scores")
    for done in (nodes, adj, *[x for x in steps if x is not scores]):
        drop_staged(done)
    return scores.where("score > 0")


def ppr_memories(edges: DataFrame, scores: DataFrame, limit: int = 20, include_historical: bool = False) -> DataFrame:
    """Memories (edges' source hashes) by the sum of edge weight x score over the best 2 x limit nodes.

    For each memory and node only the first edge counts (by id; among historical ones those from the
    node come first). Edges without a hash are scored by their evidence, once, by the best node's
    first edge. Columns: content, content_hash, score; best first.
    """
    best = scores.orderBy(F.desc(F.round("score", 12)), "node").limit(2 * limit)
    adj = adjacency(current(edges, include_historical))
    order = ["is_target", "id"] if include_historical else ["id"]
    # Scores carry fully lowered names, edges are found by A-Z folding alone.
    near = adj.join(F.broadcast(best.select(F.col("node").alias("entity"), "score")), F.col("node") == nocase("entity"))
    near = near.withColumn("value", _weight() * F.col("score")).withColumn("hash", F.nullif(F.col("source_hash"), F.lit("")))
    first = near.where(F.col("hash").isNotNull()).withColumn("__n", F.row_number().over(Window.partitionBy("hash", "entity").orderBy(*order))).where("__n = 1")
    place = F.struct((-F.col("score")).alias("s"), "entity", *order)
    backed = first.groupBy(F.col("hash").alias("content_hash")).agg(F.min_by(F.coalesce("evidence", F.lit("")), place).alias("content"), F.sum("value").alias("score"))
    loose = near.where(F.col("hash").isNull() & (F.coalesce("evidence", F.lit("")) != ""))
    orphans = loose.groupBy(F.col("evidence").alias("content")).agg(F.min_by("value", place).alias("score")).select(F.lit("").alias("content_hash"), "content", "score")
    return backed.unionByName(orphans).orderBy(F.desc(F.round("score", 12)), "content_hash", "content").limit(limit)
