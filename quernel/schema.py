"""Schemas of the stored tables. Unknown text and dates are null, never ''."""

from __future__ import annotations

MEMORIES = "id long, content string, date date, mood string, ts timestamp, content_hash string, tags array<string>, event_time date"
VECTORS = "content_hash string, embedding array<float>"
NAME_VECTORS = "name string, embedding array<float>"
NODES = "id long, name string, type string, mention_count long, first_seen date, last_seen date, is_canonical boolean, confidence double"
EDGES = "id long, source string, target string, rel_type string, weight double, evidence string, source_hash string, event_time date, valid_from date, valid_until date, last_reinforced date"
ALIASES = "id long, alias string, canonical string"
CLUSTERS = "cluster_id long, label string, entity_name string"
MERGE_LOG = "source_name string, target_name string, merge_type string, vector_sim double, name_sim double, ts timestamp"

TABLES = {"memories": MEMORIES, "vectors": VECTORS, "name_vectors": NAME_VECTORS, "nodes": NODES, "edges": EDGES, "aliases": ALIASES, "clusters": CLUSTERS, "merge_log": MERGE_LOG}

#: What all three legs of a search return.
HITS = "content string, date date, mood string, ts timestamp, score double, source string, content_hash string, event_time date"
ENTITY_INPUT = "array<struct<name: string, type: string, confidence: double>>"
RELATION_INPUT = "array<struct<source: string, target: string, rel_type: string, weight: double, evidence: string>>"
