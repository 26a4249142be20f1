"""Exact nearest neighbours: one scan, distances as built-in expressions, top k per partition first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.similarity import cosine, distance_score, l2


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    if metric == "l2":
        return l2(a, b)
    if metric == "cosine":
        return 1 - cosine(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def knn(vectors: DataFrame, query: list[float], limit: int = 20, metric: str = "l2", tie: str = "content_hash") -> DataFrame:
    """The ``limit`` nearest rows of ``vectors`` with ``distance``; ties by ``tie``; null vectors never match."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.where(F.col("embedding").isNotNull()).withColumn("distance", distance(F.col("embedding"), q, metric)).orderBy("distance", tie).limit(limit)


def vector_search(vectors: DataFrame, query: list[float], limit: int = 20, metric: str = "l2") -> DataFrame:
    """The vector leg of a search: scores, but no contents (they come in when results are hydrated)."""
    found = knn(vectors, query, limit, metric)
    none = lambda t: F.lit(None).cast(t)
    return found.select(F.lit("").alias("content"), none("date").alias("date"), F.lit("").alias("mood"), none("timestamp").alias("ts"), distance_score(F.col("distance")).alias("score"), F.lit("vector").alias("source"), "content_hash", none("date").alias("event_time"), F.col("content_hash").alias("__tie"))
