"""The engine over a store, end to end: write, search, resolve, maintain, export; and the command line."""

import json
from datetime import date, datetime, timedelta, timezone

import pyarrow as pa
import pytest

from quernel.__main__ import parser, run
from quernel.functions.embedding import HashVectors
from quernel.service import Engine
from quernel.sources.store import Store, parse_entities, parse_relations

NOW = datetime(2026, 2, 27, 10, tzinfo=timezone(timedelta(hours=7)))
LATER = NOW + timedelta(days=120)


def planned(dimensions, same):
    """Vectors of one's own: some texts have those of another one. (A class made here travels by value.)"""

    class Planned:
        def __init__(self):
            self.dimensions = dimensions

        def vectors(self, texts):
            return HashVectors(dimensions).vectors(pa.array([same.get(t, t) for t in texts.to_pylist()], pa.string()))

    return Planned()


def test_write_search_and_maintain(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/s")
    first = e.save_memory("Anna met Bob in Paris", mood="happy", tags=["trip"], event_time=date(2026, 2, 20), now=NOW)
    second = e.save_memory("Bob drinks tea", now=NOW)
    e.save_memory("Bob drinks tea", now=LATER)
    assert e.store.read("memories").count() == 2 and spark.read.text(f"file://{tmp_path}/s/log").count() > 9
    assert e.list_memory_dates()["dates"] == [NOW.date()]
    got = e.kg_index(first["content_hash"], '[{"name": "Anna", "type": "PERSON"}, {"name": "Bob", "type": "PERSON", "confidence": 0.7}]', '[{"source": "Anna", "target": "Bob", "rel_type": "KNOWS", "weight": 1.0, "evidence": "met"}]', now=NOW)
    assert got["status"] == "indexed" and (got["entities_added"], got["relationships_added"]) == (2, 1)
    e.kg_index(second["content_hash"], '[{"name": "Bob"}, {"name": "Tea"}]', '[{"source": "Bob", "target": "Tea"}, {"source": "Anna", "target": "Bob", "rel_type": "KNOWS", "weight": 0.0}]', now=NOW)
    edge = e.store.read("edges").where("rel_type = 'KNOWS'").first()
    assert edge.weight == 0.5 and edge.source_hash == second["content_hash"]
    bob = next(x for x in e.list_entities()["entities"] if x["name"] == "Bob")
    assert bob["mentions"] == 2 and bob["type"] == "TOPIC" and bob["confidence"] == 1.0
    found = e.search_memories("tea", limit=2, now=NOW)
    assert found["results"][0]["content"] == "Bob drinks tea" and found["results"][0]["source"] == "bm25"
    assert "graph_context" in e.search_memories("who", entities=["Anna"], now=NOW)
    assert e.recall_entity("Anna")["connected_count"] == 3 and e.explain_connection("Anna", "Tea")["connected"]
    assert e.get_timeline(sort_by="event_time")["count"] == 1 and e.get_timeline()["count"] == 2
    assert e.kg_alias("Bob", ["Bobby", " bob "])["aliases_added"] == ["Bobby"]
    assert next(x for x in e.list_entities()["entities"] if x["name"] == "Bob")["aliases"] == ["Bobby"]
    report = e.consolidate(now=LATER)
    assert report["decay"]["edges_decayed"] == 2 and report["stale_memories"]["count"] == 2 and report["clusters"]["cluster_count"] == 2
    assert e.get_cluster("TOPIC")["entity_count"] >= 2
    assert e.kg_invalidate(LATER.date(), target="tea")["edges_updated"] == 1 and e.kg_invalidate(LATER.date())["status"] == "no_match"
    data = e.get_graph_data()
    assert len(data["links"]) == 2 and {n["id"] for n in data["nodes"]} == {"Anna", "Bob", "Tea", "Bobby"}
    assert json.loads(e.export_json())["nodes"] and "<svg" in e.export_html()
    e.store.vacuum()
    assert e.store.read("memories").count() == 2


def test_merges(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/m", planned(16, {"Anna Lea": "Anna Lee"}))
    e.kg_index("h", '[{"name": "Anna Lee"}, {"name": "Anna Lee"}, {"name": "Tom"}]', '[{"source": "Anna Lee", "target": "Tom"}]', now=NOW)
    assert e.merge("Tom", "tom", NOW)["reason"] == "self-merge" and e.merge("Nobody", "Tom", NOW)["reason"] == "source not found"
    assert e.merge("Anna Lee", "Tom", NOW)["status"] == "merged"
    assert e.store.read("edges").count() == 0 and e.store.read("merge_log").count() == 1
    assert [x["aliases"] for x in e.list_entities()["entities"]] == [["Anna Lee"]]
    assert e.dedup_scan()["total_scanned"] == 0


def test_bad_input(spark, tmp_path):
    for bad in ("{", '{"name": 1}', '[{"type": "X"}]', "[1]"):
        with pytest.raises(ValueError):
            parse_entities(spark, bad)
    assert [tuple(r) for r in parse_relations(spark, '[{"source": "a", "target": "b"}]').drop("seq").collect()] == [("a", "b", "TOPICAL", 0.5, "")]
    assert parse_entities(spark, "").count() == 0
    assert Store(spark, f"file://{tmp_path}/none").read("nodes").count() == 0


def test_old_snapshots_gain_columns(spark, tmp_path):
    spark.createDataFrame([(1, "A")], "id long, name string").write.parquet(f"file://{tmp_path}/o/nodes/v1")
    row = Store(spark, f"file://{tmp_path}/o").read("nodes").first()
    assert row.name == "A" and row.confidence is None


def test_command_line(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/c")
    call = lambda *a: run(e, parser().parse_args(["--store", "x", *a]))
    h = call("save", "hello paris", "--tags", "a, b")["content_hash"]
    call("kg-index", h, "--entities", '[{"name": "Paris", "type": "PLACE"}]')
    assert call("search", "paris")["count"] == 1 and call("entities")["count"] == 1 and call("timeline")["timeline"][0]["tags"] == ["a", "b"]
    assert call("clusters")["cluster_count"] == 1 and call("cluster", "PLACE")["entities"] == ["Paris"]
    assert call("connect", "Paris", "paris")["connected"] and call("recall", "Paris")["connected_count"] == 0
    assert json.loads(call("export-graph"))["nodes"][0]["id"] == "Paris"


def test_a_commit_is_seen_as_a_whole(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/w")
    rows = lambda *n: spark.createDataFrame([(i, f"a{i}", "c") for i in n], "id long, alias string, canonical string")
    s.commit({"aliases": rows(1)}, {"clusters": spark.createDataFrame([(1, "X", "a")], "cluster_id long, label string, entity_name string")})
    for i in range(2, 5):
        s.append("aliases", rows(i))
    assert sorted(r.id for r in s.read("aliases").collect()) == [1, 2, 3, 4] and s.read("clusters").count() == 1

    class Broken(Store):
        def _write(self, table, rows):
            if table == "clusters":
                raise OSError("disk full")
            return super()._write(table, rows)

    with pytest.raises(OSError, match="full"):
        Broken(spark, s.path).commit({"aliases": rows(9), "clusters": s.read("clusters")})
    assert sorted(r.id for r in s.read("aliases").collect()) == [1, 2, 3, 4]
    s.vacuum(keep=1)
    assert sorted(r.id for r in s.read("aliases").collect()) == [1, 2, 3, 4] and len(s._names("aliases")) == 4 and len(s._manifests()) == 1


def test_searches_use_the_index_while_it_has_all_memories(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/i")
    e.save_memory("red apple", now=NOW)
    e.save_memory("green apple, red leaf", now=NOW)
    assert e._index(e.store.read("memories")) and [r["content"] for r in e.search_memories("red-leaf", limit=1, now=NOW)["results"]] == ["green apple, red leaf"]
    e.store.append("memories", spark.createDataFrame([(77, "a red leaf", "x")], "id long, content string, content_hash string"))
    assert e._index(e.store.read("memories")) is None
    e.reindex()
    assert e._index(e.store.read("memories"))
