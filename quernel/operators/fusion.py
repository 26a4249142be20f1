"""Reciprocal rank fusion of result lists, and what comes after it."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.temporal import in_range


def ranked(leg: DataFrame, number: int) -> DataFrame:
    """A leg with ``__leg`` and ``__pos`` (from 0), by falling score, ties by its ``__tie`` column.

    A leg is cut to a limit before, so ranking it in one task is bounded.
    """
    tie = "__tie" if "__tie" in leg.columns else "content_hash"
    w = Window.orderBy(F.desc("score"), tie)
    return leg.withColumn("__pos", F.row_number().over(w) - 1).withColumn("__leg", F.lit(number)).drop("__tie")


def rrf(legs: list[DataFrame], k: int = 60, limit: int = 10, weights: list[float] | None = None) -> DataFrame:
    """Sum of weight / (k + place) over the legs, by content hash or, without one, by content.

    Every other column is that of the row's first appearance, legs in the order given. Ties stay in
    the order of first appearance. ``rank`` counts from 1.
    """
    weights = weights or [1.0] * len(legs)
    rows = reduce(DataFrame.unionByName, [ranked(leg, i).withColumn("__w", F.lit(float(w))) for i, (leg, w) in enumerate(zip(legs, weights, strict=True))])
    columns = [c for c in rows.columns if not c.startswith("__") and c != "score"]
    key = F.coalesce(F.nullif(F.col("content_hash"), F.lit("")), F.col("content"))
    place = F.struct("__leg", "__pos")
    merged = rows.groupBy(key.alias("__key")).agg(F.sum(F.col("__w") / (k + F.col("__pos") + 1)).alias("score"), F.min_by(F.struct(*columns), place).alias("__first"), F.min(place).alias("__place"))
    # Scores that differ by rounding only are ties.
    best = merged.withColumn("__s", F.round("score", 12)).orderBy(F.desc("__s"), "__place").limit(limit)
    w = Window.orderBy(F.desc("__s"), "__place")
    return best.select(*[F.col(f"__first.{c}").alias(c) for c in columns], "score", F.row_number().over(w).alias("rank"))


def date_filter(results: DataFrame, start: date | Column | None, end: date | Column | None) -> DataFrame:
    """After the cut: rows whose event time, or else date, is known to lie outside go."""
    if start is None and end is None:
        return results
    return results.where(in_range(F.coalesce("event_time", "date"), start, end, keep_unknown=True))


def hydrate(results: DataFrame, memories: DataFrame) -> DataFrame:
    """Contents, dates and moods from the memories; rows without a memory keep their own.

    ``results`` are cut to a search's limit, so their hashes may be broadcast: memories are read once,
    without a shuffle, and what is left of them is as small as the results.
    """
    hashes = F.broadcast(results.select("content_hash").distinct())
    m = memories.join(hashes, "content_hash", "left_semi").select("content_hash", *[F.col(c).alias(f"__{c}") for c in ("content", "date", "mood", "event_time")])
    wide = results.join(F.broadcast(m), "content_hash", "left")
    there = F.col("__content").isNotNull()
    pick = lambda c: F.when(there, F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    out = {c: F.col(c) for c in results.columns} | {c: pick(c) for c in ("content", "date", "mood")} | {"event_time": F.coalesce("__event_time", "event_time").alias("event_time")}
    return wide.select(*[out[c] for c in results.columns])
