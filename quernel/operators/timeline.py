"""Memories by time, and the catalogue of names and dates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.temporal import in_range
from quernel.functions.text import nocase


def timeline(memories: DataFrame, start: date | None = None, end: date | None = None, limit: int = 50, sort_by: str = "date") -> DataFrame:
    """The newest ``limit`` memories of a range, oldest first.

    ``sort_by``: ``date`` (when saved; with the time of day) or ``event_time`` (rows without one go).
    """
    if sort_by not in ("date", "event_time"):
        raise ValueError("sort_by is date or event_time")
    rows = memories.where(F.col(sort_by).isNotNull() & in_range(F.col(sort_by), start, end))
    order = [sort_by, *(["ts"] if sort_by == "date" and "ts" in memories.columns else []), "id"]
    return rows.orderBy(*[F.desc(c) for c in order]).limit(limit).orderBy(*order)


def stale(memories: DataFrame, as_of: date, older_than_days: int = 30, limit: int = 50) -> DataFrame:
    """The newest ``limit`` of the memories saved ``older_than_days`` or more before ``as_of``."""
    from datetime import timedelta

    return timeline(memories, None, as_of - timedelta(days=older_than_days), limit)


def dates(memories: DataFrame) -> DataFrame:
    return memories.select("date").distinct().orderBy(F.desc("date"))


def first_by_hash(memories: DataFrame) -> DataFrame:
    """One memory per content hash, the one saved first."""
    columns = F.struct(*memories.columns)
    return memories.groupBy("content_hash").agg(F.min_by(columns, "id").alias("m")).select("m.*")


def entities_with_aliases(nodes: DataFrame, aliases: DataFrame, limit: int = 50) -> DataFrame:
    """The most mentioned entities, ties by name, each with its aliases (joined by "|||" if there are any).

    The cut comes before the join, so only a few names' aliases are gathered.
    """
    top = nodes.orderBy(F.desc("mention_count"), "name").limit(limit)
    named = top.join(aliases.select("alias", nocase("canonical").alias("__c")), nocase("name") == F.col("__c"), "left")
    keys = ["name", "type", "mention_count", "confidence"]
    return named.groupBy(*keys).agg(F.array_sort(F.collect_list("alias")).alias("aliases")).orderBy(F.desc("mention_count"), "name")


def export_nodes(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """All nodes with their aliases; a blank type is UNKNOWN."""
    per = aliases.groupBy(nocase("canonical").alias("__c")).agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    wide = nodes.join(per, nocase("name") == F.col("__c"), "left")
    return wide.select("name", F.coalesce(F.nullif("type", F.lit("")), F.lit("UNKNOWN")).alias("type"), "mention_count", "first_seen", "last_seen", "confidence", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def export_edges(edges: DataFrame) -> DataFrame:
    """All edges, also invalid ones; a weight of 0 or null is 0.5."""
    weight = F.when(F.coalesce("weight", F.lit(0.0)) == 0, 0.5).otherwise(F.col("weight"))
    return edges.select("source", "target", F.col("rel_type").alias("relation"), weight.alias("weight"), "evidence", "event_time", "valid_from", "valid_until", "last_reinforced")


# Colours of known types (upper case), and those dealt to other types in turn.
TYPE_COLOURS = {
    "EMOTION": "#e94560",
    "LIFE_EVENT": "#9b59b6",
    "DECISION": "#D97757",
    "LESSON": "#1abc9c",
    "PERSON": "#4287f5",
    "PEOPLE": "#4287f5",
    "TOPIC": "#95a5a6",
    "PROJECT": "#2ecc71",
    "ORGANIZATION": "#3498db",
    "ORG": "#3498db",
    "PLACE": "#f1c40f",
    "LOCATION": "#f39c12",
    "CONCEPT": "#e67e22",
    "TASK": "#16a085",
    "EVENT": "#8e44ad",
}
OTHER_COLOURS = ["#e74c3c", "#e67e22", "#f39c12", "#27ae60", "#2980b9", "#8e44ad", "#16a085", "#c0392b"]


def drawn_nodes(nodes: DataFrame) -> DataFrame:
    """Size and colour of each node in a drawing; types without a colour get one in order of name."""
    nodes = nodes.withColumn("__t", F.upper("type"))
    table = F.create_map(*[F.lit(x) for kv in TYPE_COLOURS.items() for x in kv])
    others = nodes.select("__t").distinct().where(~F.col("__t").isin(list(TYPE_COLOURS))).withColumn("__i", F.row_number().over(Window.orderBy("__t")) - 1)
    wide = nodes.join(others, "__t", "left")
    colour = F.coalesce(F.try_element_at(table, F.col("__t")), F.element_at(F.array(*map(F.lit, OTHER_COLOURS)), (F.pmod(F.coalesce("__i", F.lit(0)), F.lit(len(OTHER_COLOURS))) + 1).cast("int")))
    return wide.select("name", "type", F.least(15 + 3 * F.col("mention_count"), F.lit(60)).alias("size"), colour.alias("color"))


def drawn_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Width and short evidence of each link whose ends are both there."""
    known = nodes.select("name")
    both = links.join(known.withColumnRenamed("name", "source"), "source", "left_semi").join(known.withColumnRenamed("name", "target"), "target", "left_semi")
    return both.select("source", "target", "relation", F.greatest(F.lit(1.0), 3 * F.col("weight")).alias("width"), F.substring("evidence", 1, 120).alias("title"))
