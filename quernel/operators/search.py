"""The tri-hybrid search: text, vector and graph legs, fused; and what is built on traversals."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions.temporal import in_range, temporal_range
from quernel.functions.text import clean_query, seed_words, whole_word
from quernel.operators import fusion, graph, pagerank
from quernel.operators.text_search import bm25_search
from quernel.operators.vector_search import vector_search


@dataclass
class Tables:
    """What a search reads. ``vectors`` may be None: then there is no vector leg. Without an index texts are scanned."""

    memories: DataFrame
    nodes: DataFrame
    edges: DataFrame
    aliases: DataFrame
    vectors: DataFrame | None = None
    index: str | None = None  #: where the stored full-text index is


def _empty_leg(memories: DataFrame) -> DataFrame:
    return memories.select("content", "date", "mood", F.lit(None).cast("timestamp").alias("ts"), F.lit(0.0).alias("score"), F.lit("").alias("source"), "content_hash", "event_time", F.lit("").alias("__tie")).limit(0)


def seeds(nodes: DataFrame, query: str, entities: list[str] | None = None) -> list[str]:
    """At most five names to start from: nodes that hold an entity, or a word of the query, as a word.

    The best mentioned ones; the most mentioned node of all is left out if another seed remains.
    """
    spark = nodes.sparkSession
    words = entities if entities else spark.range(1).select(seed_words(F.lit(query)).alias("w")).first().w
    found: dict[str, tuple[int, int]] = {}
    for r in graph.search_words(nodes, list(words), 5).collect():  # at most five a word
        found.setdefault(r.name, (-r.mention_count, len(found)))
    best = sorted(found, key=found.get)[:5]
    top = graph.top_entity(nodes).first()
    others = [n for n in best if top is None or n.lower() != top.name.lower()]
    return others or best


def graph_leg(tables: Tables, query: str, limit: int = 20, entities: list[str] | None = None, include_historical: bool = False) -> DataFrame:
    """With entities: personalised PageRank from their nodes. Without: a traversal from each seed."""
    spark = tables.memories.sparkSession
    none = lambda t: F.lit(None).cast(t)
    names = seeds(tables.nodes, query, entities)
    if names and entities:
        scores = pagerank.personalized_pagerank(tables.edges, names, include_historical=include_historical)
        found = pagerank.ppr_memories(tables.edges, scores, limit, include_historical)
        return found.select("content", none("date").alias("date"), F.lit("").alias("mood"), none("timestamp").alias("ts"), F.round("score", 12).alias("score"), F.lit("graph").alias("source"), "content_hash", none("date").alias("event_time"), F.concat_ws("|", "content_hash", "content").alias("__tie"))
    rows, seen = [], set()
    for name in names:
        for e in graph.traverse(tables.edges, tables.aliases, name, 2, limit, include_historical).edges:
            key = e.source_hash or e.evidence
            if key and (bool(e.source_hash), key) not in seen:
                seen.add((bool(e.source_hash), key))
                rows.append((e.evidence or "", float(e.weight or 0.0), e.source_hash or "", len(rows)))
    rows = sorted(rows, key=lambda r: (not r[2], r[3]))  # those with a memory come before those without
    rows = sorted(rows, key=lambda r: -r[1])[:limit]
    found = spark.createDataFrame([(*r[:3], f"{i:09d}") for i, r in enumerate(rows)], "content string, score double, content_hash string, __tie string")
    return found.select("content", none("date").alias("date"), F.lit("").alias("mood"), none("timestamp").alias("ts"), "score", F.lit("graph").alias("source"), "content_hash", none("date").alias("event_time"), "__tie")


def search_memories(tables: Tables, query: str, query_vector: list[float] | None = None, limit: int = 10, date_from: date | None = None, date_to: date | None = None, entities: list[str] | None = None, include_historical: bool = False, as_of: date | None = None, hydrate_before_filter: bool = False, mode: str = "and") -> DataFrame:
    """Fused results, hydrated: content, date, mood, event_time, score, source, content_hash, rank.

    The dates of the query apply after the cut to ``limit``, to rows that carry a date by then: those
    first found by the text leg. With entities the vector leg has no contents to hold an entity yet
    and so adds nothing, unless ``hydrate_before_filter``.
    """
    said = temporal_range(F.lit(query), F.lit(as_of)) if date_from is None and date_to is None and as_of is not None else None
    m = tables.memories
    text = " ".join(x for x in (clean_query(e, True) for e in entities) if x) if entities else clean_query(query)
    legs = [bm25_search(m, text, limit * 3, mode, tables.index) if text else _empty_leg(m)]
    if tables.vectors is None or query_vector is None:
        legs.append(_empty_leg(m))
    elif not entities:
        legs.append(vector_search(tables.vectors, query_vector, limit * 3))
    else:
        near = vector_search(tables.vectors, query_vector, limit * 5)
        near = fusion.hydrate(near.withColumn("rank", F.lit(0)), m).drop("rank") if hydrate_before_filter else near
        wanted = F.array(*[F.lit(e.lower()) for e in entities])
        legs.append(near.where(F.exists(wanted, lambda e: F.contains(F.lower("content"), e))))
    legs.append(graph_leg(tables, query, limit * 3, entities, include_historical))
    fused = fusion.rrf(legs, limit=limit)
    if said is None:
        fused = fusion.date_filter(fused, date_from, date_to)
    else:
        fused = fused.where(said["start"].isNull() | in_range(F.coalesce("event_time", "date"), said["start"], said["stop"], keep_unknown=True))
    out = fusion.hydrate(fused, m)
    return out.select("content", "date", "mood", "event_time", F.round("score", 4).alias("score"), "source", "content_hash", "rank").orderBy("rank")


def graph_context(tables: Tables, entities: list[str], shown: list[str], n_results: int) -> dict:
    """Nodes around the entities, and up to 20 - ``n_results`` edges whose memories aren't shown yet."""
    nodes: dict[str, str] = {}
    edges = []
    for entity in entities:
        t = graph.traverse(tables.edges, tables.aliases, entity, 2, 20)
        for n in t.nodes.values():
            nodes.setdefault(n, n)
        edges += t.edges
    skip, top = set(shown), []
    for e in sorted(edges, key=lambda e: -(e.weight or 0)):
        if e.source_hash and e.source_hash not in skip:
            skip.add(e.source_hash)
            top.append(e)
    top = top[: max(0, 20 - n_results)]
    spark = tables.memories.sparkSession
    named = spark.createDataFrame([(n,) for n in nodes], "name string")
    rows = graph.enrich(tables.nodes, named).select("name", "type", "mention_count").collect()
    full = contents(tables.memories, [e.source_hash for e in top])
    return {
        "nodes": [r.asDict() for r in rows],
        "evidence": [{"source": e.source, "target": e.target, "type": e.rel_type, "weight": round(e.weight or 0, 2), "evidence": full.get(e.source_hash, {}).get("content", e.evidence or "")} for e in top],
    }


def contents(memories: DataFrame, hashes: list[str]) -> dict[str, dict]:
    """Memories by hash, for a handful of hashes."""
    if not hashes:
        return {}
    rows = memories.where(F.col("content_hash").isin(sorted(set(hashes)))).collect()
    return {r.content_hash: r.asDict() for r in rows}


def recall_entity(tables: Tables, entity: str, max_hops: int = 2, limit: int = 10, include_historical: bool = False) -> dict:
    t = graph.traverse(tables.edges, tables.aliases, entity, max_hops, limit, include_historical)
    spark = tables.memories.sparkSession
    named = spark.createDataFrame([(n,) for n in t.nodes.values()], "name string")
    rows = graph.enrich(tables.nodes, named).collect()
    hashes = list(dict.fromkeys(e.source_hash for e in t.edges if e.source_hash))
    full = contents(tables.memories, hashes)
    return {
        "entity": entity,
        "connected_count": len(t.nodes),
        "nodes": [r.asDict() for r in rows],
        "relationships": [{"source": e.source, "target": e.target, "type": e.rel_type, "weight": e.weight} for e in t.edges],
        "source_memories": [{k: full[h][k] for k in ("content", "date", "mood", "content_hash")} for h in hashes if h in full],
    }


def explain_connection(tables: Tables, a: str, b: str, include_historical: bool = False) -> dict:
    path = graph.find_path(tables.edges, a, b, include_historical)
    steps = list(zip(path, path[1:], strict=False))
    hashes = []
    if steps:
        spark = tables.memories.sparkSession
        wanted = spark.createDataFrame([(i, *sorted((x.lower(), y.lower()))) for i, (x, y) in enumerate(steps)], "step int, a string, b string")
        ends = graph.current(tables.edges, include_historical).select("id", "source_hash", F.least(F.lower("source"), F.lower("target")).alias("a"), F.greatest(F.lower("source"), F.lower("target")).alias("b"))
        first = ends.join(F.broadcast(wanted), ["a", "b"]).groupBy("step").agg(F.min_by("source_hash", "id").alias("source_hash"))  # one row a step
        hashes = [r.source_hash for r in first.orderBy("step").collect() if r.source_hash]
    spark = tables.memories.sparkSession
    rows = graph.enrich(tables.nodes, spark.createDataFrame([(n,) for n in path], "name string")).collect() if path else []
    full = contents(tables.memories, hashes)
    return {"from": a, "to": b, "connected": bool(path), "paths": [path] if path else [], "nodes": [{"name": r.name, "type": r.type} for r in rows], "source_memories": [{"content": full[h]["content"], "date": full[h]["date"], "content_hash": h} for h in dict.fromkeys(hashes) if h in full]}
