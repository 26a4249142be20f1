"""The temporal graph as folds over an append-only log, and its maintenance.

State is never changed in place: every operator takes tables and returns new ones.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.temporal import decayed
from quernel.functions.text import nocase

EDGE = ["source", "target", "rel_type"]


def fold_edges(log: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """Assertions ``(source, target, rel_type, weight, evidence, source_hash, event_time, seq)`` -> edges.

    The first assertion sets the weight, each later one halves the distance: w <- (w + x) / 2. In
    closed form a sum with weights 2^-(n-1) for the first and 2^-(n-i+1) for the i-th; so rows only
    need their place from the end, and terms beyond 2^-1000 vanish. Last evidence, hash and event
    time win; ``valid_from`` is the first event time, ``last_reinforced`` the last one.
    """
    w = Window.partitionBy(*EDGE).orderBy("seq")
    placed = log.withColumn("__i", F.row_number().over(w)).withColumn("__n", F.count("*").over(Window.partitionBy(*EDGE)))
    share = F.pow(F.lit(0.5), F.when(F.col("__i") == 1, F.col("__n") - 1).otherwise(F.col("__n") - F.col("__i") + 1))
    last = F.max_by(F.struct("evidence", "source_hash", "event_time"), "seq").alias("__last")
    out = placed.groupBy(*EDGE).agg(F.sum(F.col("weight") * share).alias("weight"), last, F.min_by("event_time", "seq").alias("valid_from"), F.count("*").alias("assertions"), *[c.alias(n) for n, c in (extra or {}).items()])
    return out.select(*EDGE, "weight", F.col("__last.evidence").alias("evidence"), F.col("__last.source_hash").alias("source_hash"), F.col("__last.event_time").alias("event_time"), "valid_from", F.col("__last.event_time").alias("last_reinforced"), "assertions", *(extra or {}))


def fold_nodes(log: DataFrame) -> DataFrame:
    """Mentions ``(name, type, date, confidence, seq)`` -> nodes.

    Counts mentions; the last type that isn't blank, the first and last date, the largest confidence.
    """
    typed = F.nullif(F.col("type"), F.lit(""))
    return log.groupBy("name").agg(
        F.max_by(typed, F.when(typed.isNotNull(), F.col("seq"))).alias("type"),
        F.count("*").alias("mention_count"),
        F.min_by("date", "seq").alias("first_seen"),
        F.max_by("date", "seq").alias("last_seen"),
        F.max(F.coalesce("confidence", F.lit(1.0))).alias("confidence"),
    )


def upsert_edges(edges: DataFrame, log: DataFrame) -> DataFrame:
    """The edges after new assertions: an edge that is there counts as the first one.

    It keeps its validity (an invalidated edge stays so) and its id; new edges get none.
    """
    folded = fold_edges(log).withColumnRenamed("weight", "__w")
    new = folded.select(*EDGE, "__w", "assertions", *[F.col(c).alias(f"__{c}") for c in ("evidence", "source_hash", "event_time", "valid_from", "last_reinforced")])
    both = edges.join(new, EDGE, "full_outer")
    # With w in front of n assertions whose own fold is f and whose first is x: the first one enters by half.
    first = log.groupBy(*EDGE).agg(F.min_by("weight", "seq").alias("__x"))
    both = both.join(first, EDGE, "left")
    n = F.col("assertions")
    onto = F.col("weight") * F.pow(F.lit(0.5), n) + (F.col("__w") - F.col("__x") * F.pow(F.lit(0.5), n - 1)) + F.col("__x") * F.pow(F.lit(0.5), n)
    had, got = F.col("weight").isNotNull(), F.col("__w").isNotNull()
    pick = lambda c: F.when(got, F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    columns = {c: F.col(c) for c in edges.columns}
    columns["weight"] = F.when(had & got, onto).when(got, F.col("__w")).otherwise(F.col("weight")).alias("weight")
    for c in ("evidence", "source_hash", "event_time", "last_reinforced"):
        columns[c] = pick(c)
    columns["valid_from"] = F.coalesce("valid_from", "__valid_from").alias("valid_from")
    return both.select(*columns.values())


def invalidate_edges(edges: DataFrame, valid_until: date, source: str = "", target: str = "", rel_type: str = "") -> tuple[DataFrame, Column]:
    """Edges with ``valid_until`` set where all given ends match (A-Z without case), and that condition.

    Blank arguments don't constrain; with none given nothing matches. Invalid edges are set again.
    """
    given = {c: v for c, v in (("source", source), ("target", target), ("rel_type", rel_type)) if v}
    hit = F.lit(bool(given))
    for c, v in given.items():
        hit = hit & (nocase(c) == nocase(F.lit(v)))
    hit = F.coalesce(hit, F.lit(False))
    return edges.withColumn("valid_until", F.when(hit, F.lit(valid_until)).otherwise(F.col("valid_until"))), hit


def current(edges: DataFrame, include_historical: bool = False) -> DataFrame:
    """Edges without an end; one that ends in the future is hidden, too."""
    return edges if include_historical else edges.where(F.col("valid_until").isNull())


def decay(edges: DataFrame, as_of: date, half_life_days: float = 90, min_weight: float = 0.1) -> DataFrame:
    """The edges that lose weight by ``as_of``: keys, old_weight, new_weight, days, last_reinforced.

    Only current edges reinforced before ``as_of``; a weight under the floor rises to it. Half lives
    of 0 or less change nothing. ``last_reinforced`` stays, so running twice decays twice.
    """
    days = F.datediff(F.lit(as_of), "last_reinforced")
    new = decayed(F.col("weight"), days, half_life_days if half_life_days > 0 else 1, min_weight)
    found = current(edges).where((F.lit(half_life_days) > 0) & F.col("last_reinforced").isNotNull() & (days > 0))
    rows = found.select(*EDGE, F.round(F.col("weight") + 1e-9, 6).alias("old_weight"), F.round(new, 6).alias("new_weight"), days.alias("days_since_reinforced"), "last_reinforced", (new != F.col("weight")).alias("__changed"))
    return rows.where("__changed").drop("__changed")


def with_decay(edges: DataFrame, as_of: date, half_life_days: float = 90, min_weight: float = 0.1) -> DataFrame:
    """All edges, weights after decay."""
    days = F.datediff(F.lit(as_of), "last_reinforced")
    due = F.coalesce((F.lit(half_life_days) > 0) & F.col("valid_until").isNull() & (days > 0), F.lit(False))
    return edges.withColumn("weight", F.when(due, decayed(F.col("weight"), days, half_life_days if half_life_days > 0 else 1, min_weight)).otherwise(F.col("weight")))
