"""Entity resolution: similar names by vector and spelling, and audited merges."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.similarity import jaro_winkler_udf, length_ratio, unit, unit_cosine
from quernel.functions.text import nocase

VEC_AUTO, NAME_AUTO, VEC_CANDIDATE, MIN_RATIO = 0.98, 0.85, 0.90, 0.33
CANDIDATE_COLUMNS = ["source", "target", "vector_sim", "name_sim", "decision"]


def _decided(pairs: DataFrame, vec_auto: float, name_auto: float, vec_candidate: float) -> DataFrame:
    """Vector similarity first: spelling, the slow part, only for pairs that pass it."""
    near = pairs.withColumn("vector_sim", unit_cosine(F.col("__va"), F.col("__vb"))).where(F.col("vector_sim") >= vec_candidate)
    named = near.withColumn("name_sim", jaro_winkler_udf("source", "target"))
    auto = (F.col("vector_sim") >= vec_auto) & (F.col("name_sim") >= name_auto)
    return named.withColumn("decision", F.when(auto, "auto").otherwise("candidate")).select(*CANDIDATE_COLUMNS)


def find_similar(names: DataFrame, name: str, vector: list[float], vec_auto: float = VEC_AUTO, name_auto: float = NAME_AUTO, vec_candidate: float = VEC_CANDIDATE) -> DataFrame:
    """Other names (``name``, ``embedding``) that may be the same as one given; ties in name order."""
    probe = F.array(*[F.lit(float(x)) for x in vector])
    others = names.where(nocase("name") != nocase(F.lit(name)))
    pairs = others.select(F.lit(name).alias("source"), F.col("name").alias("target"), unit(probe).alias("__va"), unit(F.col("embedding")).alias("__vb"))
    return _decided(pairs.where(length_ratio(F.col("source"), F.col("target")) >= MIN_RATIO), vec_auto, name_auto, vec_candidate)


def pair_blocks(names: DataFrame, ratio: float = MIN_RATIO, per_key: int = 256) -> DataFrame:
    """All pairs of names whose trimmed lengths are within ``ratio`` of each other, each pair once.

    ``names(name, mention_count, embedding)``; the more mentioned one (then the smaller name) is the
    source. A pair search over all names is quadratic by its definition; it is dealt out as blocks:
    every name has a block number below ``ceil(sqrt(names / per_key))``, and a pair meets under the
    two numbers' key, so no task holds more than two blocks of about ``per_key`` names times the
    number of blocks. ``__va`` and ``__vb`` are the vectors at length 1.
    """
    n = names.count()
    blocks = max(1, round((n / per_key) ** 0.5))
    own = names.where(F.length(F.trim("name")) > 0).withColumn("embedding", unit(F.col("embedding"))).withColumn("__b", F.pmod(F.xxhash64("name"), F.lit(blocks)))
    left = own.withColumn("__key", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.struct(F.col("__b").alias("x"), i.cast("long").alias("y")))))
    right = own.withColumn("__key", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.struct(i.cast("long").alias("x"), F.col("__b").alias("y")))))
    a, b = left.alias("a"), right.alias("b")
    first = (F.col("a.mention_count") > F.col("b.mention_count")) | ((F.col("a.mention_count") == F.col("b.mention_count")) & (F.col("a.name") < F.col("b.name")))
    fits = length_ratio(F.col("a.name"), F.col("b.name")) >= ratio
    met = a.join(b, (F.col("a.__key") == F.col("b.__key")) & first & fits)
    return met.select(F.col("a.name").alias("source"), F.col("b.name").alias("target"), F.col("a.embedding").alias("__va"), F.col("b.embedding").alias("__vb"))


def scan_all(names: DataFrame, vec_auto: float = VEC_AUTO, name_auto: float = NAME_AUTO, vec_candidate: float = VEC_CANDIDATE) -> DataFrame:
    """All pairs of names that may be the same entity, decided ``auto`` or ``candidate``."""
    return _decided(pair_blocks(names), vec_auto, name_auto, vec_candidate)


def merge_edges(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Edges after ``source`` became ``target``: re-pointed, new loops dropped, parallel ones to the smallest id.

    Every spelling of the source (A-Z folded) moves to the target's spelling as given; loops that
    were there before stay.
    """
    s = nocase(F.lit(source))
    a, b = nocase("source") == s, nocase("target") == s
    was_loop = nocase("source") == nocase("target")
    moved = edges.withColumns({"__loop": was_loop, "__hit": a | b}).withColumns({"source": F.when(a, target).otherwise(F.col("source")), "target": F.when(b, target).otherwise(F.col("target"))})
    kept = moved.where(~(F.col("__hit") & (nocase("source") == nocase("target")) & ~F.col("__loop")))
    w = Window.partitionBy("source", "target", "rel_type").orderBy("id")
    return kept.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*edges.columns)


def merge_nodes(nodes: DataFrame, source: str, target: str) -> DataFrame:
    """Nodes after the merge: the first source row's mentions go to every spelling of the target."""
    s, t = nocase(F.lit(source)), nocase(F.lit(target))
    moved = nodes.where(nocase("name") == s).agg(F.min_by("mention_count", "id").alias("__m"))  # one row
    kept = nodes.where(nocase("name") != s).join(F.broadcast(moved), F.lit(True))
    hit = nocase("name") == t
    out = {c: F.col(c) for c in nodes.columns}
    out["mention_count"] = F.when(hit, F.col("mention_count") + F.coalesce("__m", F.lit(0))).otherwise(F.col("mention_count")).alias("mention_count")
    if "is_canonical" in nodes.columns:
        out["is_canonical"] = (hit | F.coalesce("is_canonical", F.lit(False))).alias("is_canonical")
    return kept.select(*out.values())


def merge_entities(tables: dict[str, DataFrame], source: str, target: str, when: datetime, merge_type: str = "auto", vector_sim: float | None = None, name_sim: float | None = None) -> tuple[dict[str, DataFrame], dict]:
    """New ``nodes``, ``edges``, ``aliases``, ``merge_log``, and a status: merged, or why it was skipped.

    All or nothing: the tables come back together and the old ones stay as they are.
    """
    if source.translate(_FOLD) == target.translate(_FOLD):
        return tables, {"status": "skipped", "reason": "self-merge"}
    nodes = tables["nodes"]
    there = {r[0] for r in nodes.where(nocase("name").isin(source.translate(_FOLD), target.translate(_FOLD))).select(nocase("name")).distinct().collect()}
    for name, what in ((source, "source"), (target, "target")):
        if name.translate(_FOLD) not in there:
            return tables, {"status": "skipped", "reason": f"{what} not found"}
    spark = nodes.sparkSession
    alias = spark.createDataFrame([(source, target)], "alias string, canonical string").join(tables["aliases"].select("alias", "canonical"), ["alias", "canonical"], "left_anti")
    entry = spark.createDataFrame([(source, target, merge_type, vector_sim, name_sim, when)], "source_name string, target_name string, merge_type string, vector_sim double, name_sim double, ts timestamp")
    out = tables | {
        "nodes": merge_nodes(nodes, source, target),
        "edges": merge_edges(tables["edges"], source, target),
        "aliases": tables["aliases"].unionByName(alias, allowMissingColumns=True),
        "merge_log": tables["merge_log"].unionByName(entry, allowMissingColumns=True),
    }
    return out, {"status": "merged", "source": source, "target": target}


_FOLD = {ord(a): ord(a) + 32 for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
