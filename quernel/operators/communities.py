"""Communities: connected components of the graph, their labels, and the stored clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.text import nocase
from quernel.operators.components import connected_components
from quernel.operators.temporal import current


def memberships(nodes: DataFrame, edges: DataFrame, include_historical: bool = False) -> DataFrame:
    """``(member, spelling, component)`` of all names in full lower case; components that hold a node.

    Isolated nodes are components of one. ``component`` is the smallest member.
    """
    kept = current(edges, include_historical)
    ends = kept.select(F.lower("source").alias("src"), F.lower("target").alias("dst"))
    comps = connected_components(ends)
    names = nodes.select("name").unionByName(kept.select(F.col("source").alias("name"))).unionByName(kept.select(F.col("target").alias("name")))
    spelled = names.where("name IS NOT NULL").groupBy(F.lower("name").alias("member")).agg(F.min("name").alias("spelling"))
    placed = spelled.join(comps, spelled.member == comps.node, "left").select("member", "spelling", F.coalesce("component", "member").alias("component"))
    known = placed.join(nodes.select(F.lower("name").alias("member")).distinct(), "member", "left_semi").select("component").distinct()
    return placed.join(known, "component", "left_semi")


def labels(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """``(component, label)``: the commonest type, the first by name on ties; UNKNOWN without one."""
    typed = members.join(nodes.where(F.coalesce("type", F.lit("")) != "").select(F.col("name").alias("spelling"), "type"), "spelling").groupBy("component", "type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("component").orderBy(F.desc("n"), "type")
    best = typed.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("component", F.col("type").alias("label"))
    return members.select("component").distinct().join(best, "component", "left").select("component", F.coalesce("label", F.lit("UNKNOWN")).alias("label"))


def communities(nodes: DataFrame, edges: DataFrame, include_historical: bool = False) -> DataFrame:
    """``(component, label, entity_count, edge_count, first_name)``, one row per community.

    ``edge_count``: pairs of different neighbours, without loops and parallel edges.
    """
    members = memberships(nodes, edges, include_historical)
    pairs = current(edges, include_historical).select(F.least(F.lower("source"), F.lower("target")).alias("a"), F.greatest(F.lower("source"), F.lower("target")).alias("b")).where("a < b").distinct()
    per_edge = pairs.join(members.select(F.col("member").alias("a"), "component"), "a").groupBy("component").agg(F.count("*").alias("edge_count"))
    sizes = members.groupBy("component").agg(F.count("*").alias("entity_count"), F.min(nocase("spelling")).alias("first_name"))
    return sizes.join(per_edge, "component", "left").join(labels(nodes, members), "component").select("component", "label", "entity_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"), "first_name")


def numbered(found: DataFrame) -> DataFrame:
    """``cluster_id`` from 0 by falling size, then first name.

    One row per community goes through one task: at a corpus' scale rank sizes per partition first,
    or keep ``component`` as the id, which is as good a key.
    """
    w = Window.orderBy(F.desc("entity_count"), "first_name", "component")
    return found.withColumn("cluster_id", F.row_number().over(w) - 1)


def cluster_table(nodes: DataFrame, edges: DataFrame, include_historical: bool = False) -> DataFrame:
    """``(cluster_id, label, entity_name)``: what is stored, replacing what was there."""
    ids = numbered(communities(nodes, edges, include_historical)).select("component", "cluster_id", "label")
    return memberships(nodes, edges, include_historical).join(ids, "component").select(F.col("cluster_id").cast("long").alias("cluster_id"), "label", F.col("spelling").alias("entity_name"))


def cluster_list(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_id", "label").agg(F.count("*").alias("entity_count")).orderBy(F.desc("entity_count"), "cluster_id")


def cluster_members(clusters: DataFrame, label: str) -> DataFrame:
    """Names in the first stored cluster with a label (labels are types, so several share one)."""
    first = clusters.where(F.col("label") == label).agg(F.min("cluster_id").alias("cluster_id"))
    return clusters.join(F.broadcast(first), "cluster_id").select("entity_name").orderBy("entity_name")
