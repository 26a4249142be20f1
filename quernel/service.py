"""The engine's calls over a store: saving, indexing, searching, resolving, maintaining, exporting.

Every call that changes tables writes new snapshots. Times are arguments (``now``), days are those
of UTC+7. Answers are plain dictionaries.
"""

from __future__ import annotations

import json
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions.embedding import HashVectors, vector_of, with_embedding
from quernel.functions.text import nocase
from quernel.operators import communities, graph, resolve, search, temporal, timeline
from quernel.operators.text_search import index_stats, write_index
from quernel.sources.store import Store, parse_entities, parse_relations
from quernel.workspace import delete_path, drop_staged, path_exists, ship, stage

ZONE = timezone(timedelta(hours=7))


class Engine:
    def __init__(self, spark: SparkSession, path: str, vectors_of=None) -> None:
        ship(spark)
        self.spark, self.store = spark, Store(spark, path)
        self.vectors_of = vectors_of or HashVectors(128)
        self.index = f"{self.store.path}/text-index"

    # --- writes ---------------------------------------------------------------------------------

    def save_memories(self, rows: DataFrame, now: datetime | None = None) -> None:
        """``rows(content [, mood, tags, event_time])``: new texts become memories, all go to the log."""
        now = (now or datetime.now(ZONE)).astimezone(ZONE)
        for c, kind in (("mood", "string"), ("tags", "array<string>"), ("event_time", "date")):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast(kind))
        old = self.store.read("memories")
        last = old.agg(F.max("id")).first()[0] or 0
        new = rows.select(
            (F.monotonically_increasing_id() + last + 1).alias("id"), "content", F.lit(now.date()).alias("date"), F.coalesce("mood", F.lit("")).alias("mood"), F.lit(now.replace(tzinfo=None)).alias("ts"),
            F.sha2("content", 256).alias("content_hash"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.col("event_time").cast("date").alias("event_time"),
        )
        new = stage(new, "saves")  # so that all that follows sees the same ids
        self.store.log(new)
        fresh = stage(timeline.first_by_hash(new.join(old.select("content_hash"), "content_hash", "left_anti").select(old.columns)), "saves")
        added = with_embedding(fresh.select("content_hash", "content"), "content", self.vectors_of).select("content_hash", "embedding")
        self.store.commit(append={"memories": fresh, "vectors": added.join(self.store.read("vectors"), "content_hash", "left_anti")})
        write_index(fresh, self.index)
        for done in (new, fresh):
            drop_staged(done)

    def _index(self, memories: DataFrame) -> str | None:
        """The full-text index, if it has all memories; otherwise texts are scanned until ``reindex``."""
        if not path_exists(self.spark, f"{self.index}/sizes"):
            return None
        return self.index if index_stats(self.spark, self.index).total == memories.count() else None

    def reindex(self) -> None:
        """Builds the full-text index anew."""
        delete_path(self.spark, self.index)
        write_index(self.store.read("memories"), self.index)

    def _named(self, nodes: DataFrame) -> DataFrame:
        """Names with their mentions and vectors; only names without a vector go through the source."""
        known = self.store.read("name_vectors")
        missing = nodes.select("name").distinct().join(known, "name", "left_anti")
        if not missing.isEmpty():
            self.store.append("name_vectors", with_embedding(missing, "name", self.vectors_of))
            known = self.store.read("name_vectors")
        return nodes.select("name", "mention_count").join(known, "name")

    def save_memory(self, text: str, mood: str | None = None, tags: list[str] | None = None, event_time: date | None = None, now: datetime | None = None) -> dict:
        now = (now or datetime.now(ZONE)).astimezone(ZONE)
        row = self.spark.createDataFrame([(text, mood, tags, event_time)], "content string, mood string, tags array<string>, event_time date")
        self.save_memories(row, now)
        digest = self.spark.range(1).select(F.sha2(F.lit(text), 256)).first()[0]
        return {"status": "saved", "content_hash": digest, "timestamp": now.isoformat(), "date": now.date(), "mood": mood, "tags": tags, "event_time": event_time, "vector_indexed": True}

    def kg_index(self, content_hash: str, entities: str = "[]", relationships: str = "[]", event_time: date | None = None, now: datetime | None = None) -> dict:
        """JSON entities and relationships of a memory: nodes, then merges of the same names, then edges."""
        now = (now or datetime.now(ZONE)).astimezone(ZONE)
        day = now.date()
        e, r = parse_entities(self.spark, entities), parse_relations(self.spark, relationships)
        t = self.store.tables()
        log = e.select("name", "type", "confidence", F.lit(day).alias("date"), "seq")
        self.store.write("nodes", self._with_nodes(t["nodes"], log))
        t = self.store.tables()
        names = [x.name for x in e.select("name").distinct().collect()]
        merged, candidates = [], []
        vectors = self._named(t["nodes"])
        for name in names:
            for c in resolve.find_similar(vectors, name, vector_of(self.spark, name, self.vectors_of)).orderBy("target").collect():
                item = {"source": c.source, "target": c.target, "vector_sim": round(c.vector_sim, 4), "name_sim": round(c.name_sim, 4)}
                if c.decision == "auto" and self._merge(c.source, c.target, now, "auto", c.vector_sim, c.name_sim)["status"] == "merged":
                    merged.append(item)
                elif c.decision == "candidate":
                    candidates.append(item)
        edges = self.store.read("edges")
        asserted = r.select("source", "target", "rel_type", "weight", "evidence", F.lit(content_hash).alias("source_hash"), F.lit(event_time or day).cast("date").alias("event_time"), "seq")
        after = temporal.upsert_edges(edges, asserted).withColumn("last_reinforced", F.when(F.col("id").isNull() | (F.col("source_hash") == content_hash), F.lit(now.astimezone(timezone.utc).date())).otherwise(F.col("last_reinforced")))
        last = edges.agg(F.max("id")).first()[0] or 0
        self.store.write("edges", after.withColumn("id", F.coalesce("id", F.monotonically_increasing_id() + last + 1)))
        return {"status": "indexed", "content_hash": content_hash, "entities_added": e.count(), "relationships_added": r.count(), "auto_merged": merged, "dedup_candidates": candidates}

    def _with_nodes(self, nodes: DataFrame, log: DataFrame) -> DataFrame:
        new = temporal.fold_nodes(log)
        last = nodes.agg(F.max("id")).first()[0] or 0
        both = nodes.alias("o").join(new.alias("n"), "name", "full_outer")
        return both.select(
            F.coalesce("o.id", F.monotonically_increasing_id() + last + 1).alias("id"), "name", F.coalesce("n.type", "o.type").alias("type"),
            (F.coalesce("o.mention_count", F.lit(0)) + F.coalesce("n.mention_count", F.lit(0))).alias("mention_count"), F.coalesce("o.first_seen", "n.first_seen").alias("first_seen"),
            F.coalesce("n.last_seen", "o.last_seen").alias("last_seen"), F.coalesce("o.is_canonical", F.lit(False)).alias("is_canonical"), F.greatest("o.confidence", "n.confidence").alias("confidence"),
        )

    def kg_invalidate(self, valid_until: date, source: str = "", target: str = "", rel_type: str = "", reason: str = "") -> dict:
        edges = self.store.read("edges")
        after, hit = temporal.invalidate_edges(edges, valid_until, source, target, rel_type)
        n = edges.where(hit).count()
        if n:
            self.store.write("edges", after)
        return {"status": "invalidated" if n else "no_match", "edges_updated": n, "valid_until": valid_until, "reason": reason}

    def kg_alias(self, canonical: str, aliases: list[str]) -> dict:
        """Both names become nodes (PERSON, no mentions) if they aren't; the canonical one is marked so."""
        given = [a for a in aliases if a.strip().lower() != canonical.strip().lower()]
        t = self.store.tables()
        rows = self.spark.createDataFrame([(a, canonical) for a in dict.fromkeys(given)], "alias string, canonical string")
        names = self.spark.createDataFrame([(n,) for n in dict.fromkeys([canonical, *given])], "name string").join(t["nodes"].select("name"), "name", "left_anti")
        last = t["nodes"].agg(F.max("id")).first()[0] or 0
        fresh = names.select((F.monotonically_increasing_id() + last + 1).alias("id"), "name", F.lit("PERSON").alias("type"), F.lit(0).cast("long").alias("mention_count"), F.lit(False).alias("is_canonical"), F.lit(1.0).alias("confidence"))
        nodes = t["nodes"].unionByName(fresh, allowMissingColumns=True) if given else t["nodes"]
        marked = nodes.withColumn("is_canonical", F.coalesce("is_canonical", F.lit(False)) | (F.lit(bool(given)) & (F.col("name") == canonical)))
        last = t["aliases"].agg(F.max("id")).first()[0] or 0
        new = rows.join(t["aliases"], ["alias", "canonical"], "left_anti").withColumn("id", F.monotonically_increasing_id() + last + 1)
        self.store.commit({"nodes": marked}, {"aliases": new})
        return {"status": "ok", "canonical": canonical, "aliases_added": given}

    def _merge(self, source: str, target: str, now: datetime, kind: str, vector_sim: float | None, name_sim: float | None) -> dict:
        after, status = resolve.merge_entities(self.store.tables(), source, target, now.astimezone(timezone.utc).replace(tzinfo=None), kind, vector_sim, name_sim)
        if status["status"] == "merged":
            self.store.commit({name: after[name] for name in ("nodes", "edges", "aliases", "merge_log")})
        return status

    def merge(self, source: str, target: str, now: datetime | None = None) -> dict:
        return self._merge(source, target, now or datetime.now(ZONE), "manual", None, None)

    def dedup_scan(self, auto_merge: bool = False, now: datetime | None = None) -> dict:
        """All pairs that may be the same; with ``auto_merge`` sure ones are merged one after the other."""
        names = self._named(self.store.read("nodes"))
        found = resolve.scan_all(names).orderBy(F.desc("vector_sim"), "source", "target").collect()
        as_item = lambda c: {"source": c.source, "target": c.target, "vector_sim": round(c.vector_sim, 4), "name_sim": round(c.name_sim, 4)}
        merged = [as_item(c) for c in found if auto_merge and c.decision == "auto" and self._merge(c.source, c.target, now or datetime.now(ZONE), "auto", c.vector_sim, c.name_sim)["status"] == "merged"]
        left = [as_item(c) for c in found if not (auto_merge and c.decision == "auto")]
        return {"candidates": left, "auto_merged": merged, "total_scanned": len(found)}

    # --- reads ----------------------------------------------------------------------------------

    def _tables(self) -> search.Tables:
        t = self.store.tables()
        return search.Tables(t["memories"], t["nodes"], t["edges"], t["aliases"], t["vectors"], self._index(t["memories"]))

    def search_memories(self, query: str, limit: int = 10, date_from: date | None = None, date_to: date | None = None, entities: list[str] | None = None, include_historical: bool = False, now: datetime | None = None) -> dict:
        t = self._tables()
        as_of = (now or datetime.now(ZONE)).astimezone(ZONE).date()
        rows = search.search_memories(t, query, vector_of(self.spark, query, self.vectors_of), limit, date_from, date_to, entities, include_historical, as_of).collect()
        results = [{k: v for k, v in r.asDict().items() if k != "rank"} for r in rows]
        out = {"query": query, "entities_used": entities or [], "count": len(results), "results": results}
        if entities:
            out["graph_context"] = search.graph_context(t, entities, [r["content_hash"] for r in results], len(results))
        return out

    def recall_entity(self, entity: str, max_hops: int = 2, limit: int = 10, include_historical: bool = False) -> dict:
        return search.recall_entity(self._tables(), entity, max_hops, limit, include_historical)

    def explain_connection(self, a: str, b: str, include_historical: bool = False) -> dict:
        return search.explain_connection(self._tables(), a, b, include_historical)

    def list_entities(self, limit: int = 50) -> dict:
        rows = timeline.entities_with_aliases(self.store.read("nodes"), self.store.read("aliases"), limit).collect()
        return {"count": len(rows), "entities": [{"name": r.name, "type": r.type, "mentions": r.mention_count, "confidence": r.confidence, "aliases": r.aliases} for r in rows]}

    def list_memory_dates(self) -> dict:
        rows = [r.date for r in timeline.dates(self.store.read("memories")).collect()]
        return {"count": len(rows), "dates": rows}

    def get_timeline(self, start: date | None = None, end: date | None = None, limit: int = 50, sort_by: str = "processing_time") -> dict:
        rows = timeline.timeline(self.store.read("memories"), start, end, limit, "event_time" if sort_by == "event_time" else "date").collect()
        return {"count": len(rows), "sort_by": sort_by, "timeline": [{"text": r.content, "date": r.date, "mood": r.mood, "timestamp": r.ts, "tags": r.tags, "event_time": r.event_time, "content_hash": r.content_hash} for r in rows]}

    # --- maintenance ----------------------------------------------------------------------------

    def detect_clusters(self, include_historical: bool = False) -> dict:
        nodes, edges = self.store.read("nodes"), self.store.read("edges")
        found = communities.numbered(communities.communities(nodes, edges, include_historical)).orderBy("cluster_id").collect()
        self.store.write("clusters", communities.cluster_table(nodes, edges, include_historical))
        return {"status": "ok", "cluster_count": len(found), "total_entities": sum(r.entity_count for r in found), "clusters": [{"cluster_id": r.cluster_id, "label": r.label, "entity_count": r.entity_count, "edge_count": r.edge_count} for r in found]}

    def get_cluster(self, label: str) -> dict:
        """The first cluster with a label, and the memories on its members' current edges."""
        names = communities.cluster_members(self.store.read("clusters"), label)
        adj = graph.adjacency(temporal.current(self.store.read("edges")))
        hashes = adj.join(names.select(nocase("entity_name").alias("node")), "node", "left_semi").where(F.coalesce("source_hash", F.lit("")) != "").select(F.col("source_hash").alias("content_hash")).distinct()
        memories = self.store.read("memories").join(hashes, "content_hash", "left_semi").orderBy("id").collect()
        entities = [r.entity_name for r in names.collect()]
        return {"status": "ok" if entities else "not_found", "label": label, "entity_count": len(entities), "entities": entities, "memory_count": len(memories), "memories": [{"content": m.content, "date": m.date, "content_hash": m.content_hash} for m in memories]}

    def consolidate(self, half_life_days: float = 90, older_than_days: int = 30, auto_merge: bool = False, now: datetime | None = None) -> dict:
        """Decay, merge suggestions, stale memories and clusters, in this order."""
        now = now or datetime.now(ZONE)
        day = now.astimezone(timezone.utc).date()
        edges = self.store.read("edges")
        decayed = [r.asDict() for r in temporal.decay(edges, day, half_life_days).collect()]
        if decayed:
            self.store.write("edges", temporal.with_decay(edges, day, half_life_days))
        merges = self.dedup_scan(auto_merge, now)
        stale = timeline.stale(self.store.read("memories"), now.astimezone(ZONE).date(), older_than_days).collect()
        clusters = self.detect_clusters()
        return {
            "decay": {"half_life_days": half_life_days, "edges_decayed": len(decayed), "edges": decayed},
            "merge_suggestions": {"candidates": merges["candidates"], "auto_merged": merges["auto_merged"]},
            "stale_memories": {"older_than": older_than_days, "count": len(stale), "memories": [{"content": m.content, "date": m.date, "content_hash": m.content_hash} for m in stale]},
            "clusters": {"cluster_count": clusters["cluster_count"], "total_entities": clusters["total_entities"]},
        }

    # --- exports --------------------------------------------------------------------------------

    def graph_frames(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and links of a drawing, as tables; write these for graphs of any size."""
        return timeline.export_nodes(self.store.read("nodes"), self.store.read("aliases")).orderBy(F.desc("mention_count"), "name"), timeline.export_edges(self.store.read("edges")).orderBy(F.desc("weight"), "source", "target", "relation")

    def get_graph_data(self) -> dict:
        """The whole graph as one dictionary, for graphs that a page can show."""
        nodes, links = self.graph_frames()
        return {"nodes": [{"id": r.name, **r.asDict()} for r in nodes.collect()], "links": [r.asDict() for r in links.collect()]}

    def export_json(self) -> str:
        return json.dumps(self.get_graph_data(), ensure_ascii=False, indent=2, default=str)

    def export_html(self, title: str = "Graph") -> str:
        """A page that draws the graph with plain SVG: sizes by mentions, widths by weight."""
        import html
        import math

        nodes, links = self.graph_frames()
        shown = timeline.drawn_nodes(nodes).orderBy("name").collect()
        lines = timeline.drawn_links(links, nodes).collect()
        spot = {r.name: (500 + 420 * math.cos(6.283 * i / max(1, len(shown))), 500 + 420 * math.sin(6.283 * i / max(1, len(shown)))) for i, r in enumerate(shown)}
        parts = [f'<line x1="{spot[x.source][0]:.0f}" y1="{spot[x.source][1]:.0f}" x2="{spot[x.target][0]:.0f}" y2="{spot[x.target][1]:.0f}" stroke="#999" stroke-width="{x.width:.1f}"><title>{html.escape(f"{x.relation}: {x.title or ""}")}</title></line>' for x in lines]
        parts += [f'<circle cx="{spot[r.name][0]:.0f}" cy="{spot[r.name][1]:.0f}" r="{r.size / 2:.0f}" fill="{r.color}"><title>{html.escape(f"{r.name} ({r.type})")}</title></circle>' for r in shown]
        return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><svg viewBox="0 0 1000 1000">{"".join(parts)}</svg>'
