"""Full-text search: phrase match and BM25 as expressions over one scan, and a stored index.

A query is split at white space; each piece is a phrase of one or more terms. By default all
phrases must match. A phrase lies within one of the three fields (content, date, mood); document
length counts the terms of all three.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions.text import accent_table, terms
from quernel.workspace import stage

K1, B = 1.2, 0.75


def phrases(query: str) -> list[list[str]]:
    """Pieces of the query as folded terms; pieces without any are dropped, repeats count again."""
    table = str.maketrans(*accent_table())
    pieces = (re.findall(r"[^\W_]+", p.lower().translate(table)) for p in query.split())
    return [p for p in pieces if p]


def _hits(field: Column, phrase: list[str]) -> Column:
    if len(phrase) == 1:
        return F.size(F.filter(field, lambda t: t == phrase[0]))
    last = F.size(field) - len(phrase)
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(at, lambda i: reduce(Column.__and__, [F.get(field, i + k) == t for k, t in enumerate(phrase)])))


def match_counts(memories: DataFrame, query: list[list[str]]) -> DataFrame:
    """``memories`` with ``len`` (terms) and ``f0``, ``f1``, ... (hits of each phrase)."""
    cut = F.struct(terms("content").alias("c"), terms(F.date_format("date", "yyyy-MM-dd")).alias("d"), terms("mood").alias("m"))

    def count(s: Column) -> Column:
        """All counts of a row from one cut of its fields."""
        total = lambda parts: reduce(Column.__add__, parts).cast("long")
        return F.struct(total([F.size(s[f]) for f in "cdm"]).alias("len"), *[total([_hits(s[f], p) for f in "cdm"]).alias(f"f{i}") for i, p in enumerate(query)])

    counted = memories.withColumn("__n", F.transform(F.array(cut), count)[0])
    return counted.select(*memories.columns, "__n.*")


def bm25_term(f: Column, n: Column, total: Column, length: Column, average: Column) -> Column:
    idf = F.log((total - n + 0.5) / (n + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / average))


def scored(counted: DataFrame, phrases_: int, total: Column, average: Column, limit: int, mode: str) -> DataFrame:
    """The best ``limit`` rows ``(id, rank)`` of ``counted(id, len, f0, f1, ...)``, which has all that match."""
    columns = [f"f{i}" for i in range(phrases_)]
    df = counted.agg(*[F.sum((F.col(c) > 0).cast("long")).alias(f"__n{c}") for c in columns])  # one row
    test = reduce(Column.__and__ if mode == "and" else Column.__or__, [F.col(c) > 0 for c in columns])
    rank = reduce(Column.__add__, [F.when(F.col(c) > 0, bm25_term(F.col(c), F.col(f"__n{c}"), total, F.col("len"), average)).otherwise(0.0) for c in columns])
    return counted.where(test).join(F.broadcast(df), F.lit(True)).select("id", rank.alias("rank")).orderBy(F.desc("rank"), "id").limit(limit)


def bm25(memories: DataFrame, query: str, limit: int = 20, mode: str = "and", index: str | None = None) -> DataFrame:
    """The best ``limit`` memories: all columns and ``rank``, best first, ties by id.

    With a stored index (``write_index``) its postings of the query's terms are read. Without, one
    pass over the memories counts terms; the counts are written, a few numbers a memory. Either
    way, texts come in at the end, for the rows of the result. A query without terms matches nothing.
    """
    wanted = phrases(query)
    if not wanted:
        return memories.withColumn("rank", F.lit(0.0)).limit(0)
    if index is not None:
        counted, stats = index_counts(memories.sparkSession, index, wanted), index_stats(memories.sparkSession, index)
        total, average = F.lit(stats.total), F.lit(float(stats.terms) / max(1, stats.total))
    else:
        counted = stage(match_counts(memories, wanted).select("id", "len", *[f"f{i}" for i in range(len(wanted))]), "counts")
        size = counted.agg(F.count("*").alias("total"), F.sum("len").alias("terms")).first()
        total, average = F.lit(size.total), F.lit(float(size.terms or 0) / max(1, size.total))
    best = scored(counted, len(wanted), total, average, limit, mode)
    return memories.join(F.broadcast(best), "id").select(*memories.columns, "rank").orderBy(F.desc("rank"), "id")  # limit rows


def normalised(ranked: DataFrame) -> DataFrame:
    """``score`` = rank through the largest rank (1 if that is 0); for results cut to a limit."""
    best = ranked.agg(F.max("rank").alias("__best"))
    return ranked.join(F.broadcast(best), F.lit(True)).withColumn("score", F.when(F.col("__best") > 0, F.col("rank") / F.col("__best")).otherwise(1.0)).drop("__best")


def bm25_search(memories: DataFrame, query: str, limit: int = 20, mode: str = "and", index: str | None = None) -> DataFrame:
    """The text leg of a search, in the common schema of hits."""
    found = normalised(bm25(memories, query, limit, mode, index))
    return found.select("content", "date", "mood", "ts", "score", F.lit("bm25").alias("source"), "content_hash", "event_time", F.col("id").cast("string").alias("__tie"))


def term_rows(memories: DataFrame) -> DataFrame:
    """``(term, id, tf)``: how often each term is in each memory."""
    cut = memories.select("id", F.explode(F.concat(terms("content"), terms(F.date_format("date", "yyyy-MM-dd")), terms("mood"))).alias("term"))
    return cut.groupBy("term", "id").agg(F.count("*").alias("tf"))


FIELD = 1 << 24  #: places of the second and third field begin at this and twice this, so no phrase spans two


def postings(memories: DataFrame) -> DataFrame:
    """``(term, id, tf, len, places)``: the inverted index."""
    cut = memories.select("id", F.array(terms("content"), terms(F.date_format("date", "yyyy-MM-dd")), terms("mood")).alias("t"))
    placed = F.flatten(F.transform("t", lambda f, i: F.transform(f, lambda t, k: F.struct(t.alias("term"), (i * FIELD + k).cast("int").alias("at")))))
    flat = cut.select("id", F.aggregate("t", F.lit(0), lambda n, f: n + F.size(f)).alias("len"), F.explode(placed).alias("p"))
    return flat.groupBy(F.col("p.term").alias("term"), "id", "len").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("p.at")).alias("places"))


def term_stats(index: DataFrame) -> DataFrame:
    """``(term, df, cf)``: in how many memories, how often in all."""
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def write_index(memories: DataFrame, path: str) -> None:
    """Adds the memories, which must be new to it, to the index at ``path`` as a segment of its own.

    Postings lie sorted by term and id, in files that are ranges of both: a query reads the files
    and row groups that may hold its terms, and a term that is in most memories has many files.
    """
    spark = memories.sparkSession
    segment = f"{path}/{{}}/segment={uuid.uuid4().hex}"
    ordered = postings(memories).repartitionByRange("term", "id").sortWithinPartitions("term", "id")
    ordered.write.option("parquet.block.size", 16 << 20).parquet(segment.format("postings"))
    # The size is written last: a segment counts once it has one.
    written = spark.read.parquet(segment.format("postings"))
    size = memories.agg(F.count("*").alias("total")).join(written.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("terms")), F.lit(True))
    size.coalesce(1).write.parquet(segment.format("sizes"))


def index_stats(spark: SparkSession, path: str):
    return spark.read.parquet(f"{path}/sizes").agg(F.sum("total").alias("total"), F.sum("terms").alias("terms")).first()


def index_counts(spark: SparkSession, path: str, wanted: list[list[str]]) -> DataFrame:
    """``(id, len, f0, f1, ...)`` of the memories with a hit of any phrase, from the postings of their terms."""
    names = list(dict.fromkeys(t for p in wanted for t in p))
    done = [r.segment for r in spark.read.parquet(f"{path}/sizes").select("segment").distinct().collect()]
    rows = spark.read.parquet(f"{path}/postings").where(F.col("segment").isin(done) & F.col("term").isin(names))
    one = lambda c, t: F.max(F.when(F.col("term") == t, F.col(c)))
    single = [t for p in wanted if len(p) == 1 for t in p]
    within = list(dict.fromkeys(t for p in wanted if len(p) > 1 for t in p))
    found = rows.groupBy("id", "len").agg(
        *[F.coalesce(one("tf", t), F.lit(0)).alias(f"tf_{names.index(t)}") for t in dict.fromkeys(single)], *[F.coalesce(one("places", t), F.array().cast("array<int>")).alias(f"at_{names.index(t)}") for t in within]
    )

    def hits(phrase: list[str]) -> Column:
        if len(phrase) == 1:
            return F.col(f"tf_{names.index(phrase[0])}")
        rest = [(k, F.col(f"at_{names.index(t)}")) for k, t in enumerate(phrase) if k]
        return F.size(F.filter(F.col(f"at_{names.index(phrase[0])}"), lambda p: reduce(Column.__and__, [F.array_contains(at, p + k) for k, at in rest]))).cast("long")

    return found.select("id", F.col("len").cast("long").alias("len"), *[hits(p).alias(f"f{i}") for i, p in enumerate(wanted)])


def index_search(spark: SparkSession, path: str, query: str, limit: int = 20, mode: str = "and") -> DataFrame:
    """``(id, rank)`` from a stored index alone."""
    wanted = phrases(query)
    if not wanted:
        return spark.createDataFrame([], "id long, rank double")
    stats = index_stats(spark, path)
    return scored(index_counts(spark, path, wanted), len(wanted), F.lit(stats.total), F.lit(float(stats.terms) / max(1, stats.total)), limit, mode)
