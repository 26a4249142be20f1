"""Retrieval, graph and maintenance operators on small tables, with values by hand."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quernel.functions.similarity import fake_embedding
from quernel.operators import communities, fusion, graph, pagerank, resolve, search, temporal, text_search, timeline, vector_search

DAY = date(2026, 2, 27)


def memories(spark, *texts, dates=None, moods=None):
    rows = [(i + 1, t, (dates or {}).get(i, DAY), (moods or {}).get(i, ""), f"h{i + 1}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, content string, date date, mood string, content_hash string")
    return df.select("id", "content", "date", "mood", F.col("date").cast("timestamp").alias("ts"), "content_hash", F.array().cast("array<string>").alias("tags"), F.lit(None).cast("date").alias("event_time"))


def edges(spark, *rows):
    """(source, target, rel = R, weight = 0.5, hash = '', evidence = '', valid_until = None)"""
    full = [(i + 1, *(*r, *("R", 0.5, "", "", None)[len(r) - 2 :])) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "id long, source string, target string, rel_type string, weight double, source_hash string, evidence string, valid_until date")


def nodes(spark, *rows):
    full = [(i + 1, *(*r, *("", 1)[len(r) - 1 :])) for i, r in enumerate(rows)]
    df = spark.createDataFrame(full, "id long, name string, type string, mention_count long")
    return df.select("*", F.lit(None).cast("date").alias("first_seen"), F.lit(None).cast("date").alias("last_seen"), F.lit(1.0).alias("confidence"))


def no_aliases(spark):
    return spark.createDataFrame([], "id long, alias string, canonical string")


# --- text, vectors, fusion


def test_bm25(spark):
    m = memories(spark, "cat sat", "cat cat cat sat", "a cat here", "dog", "bird", "fish", "cow")
    got = text_search.bm25(m, "cat", 10).collect()
    assert [r.id for r in got] == [2, 1, 3]
    assert text_search.bm25(m, "", 5).count() == text_search.bm25(m, "++", 5).count() == 0
    assert [r.id for r in text_search.bm25(m, "cat sat", 10).collect()] == [2, 1]
    assert {r.id for r in text_search.bm25(m, "dog bird", 10, "or").collect()} == {4, 5}


def test_phrases_stay_within_a_field(spark):
    m = memories(spark, "foo-bar: baz & x", "bar foo", "foo", moods={2: "bar"})
    assert [r.id for r in text_search.bm25(m, "foo-bar", 10).collect()] == [1]
    assert [r.id for r in text_search.bm25(m, "foo bar", 10).orderBy("id").collect()] == [1, 2, 3]
    assert text_search.bm25(m, "2026-02-27", 10).count() == 3


def test_index_agrees_with_scan(spark, tmp_path):
    """In segments that were added one after the other; phrases need positions."""
    m = memories(spark, "cat sat", "cat cat cat sat", "a cat here", "dog", "sat cat. sat-cat cat", "foo-bar baz", moods={4: "cat", 6: "bar"})
    index = f"{tmp_path}/i"
    text_search.write_index(m.where("id <= 2"), index)
    text_search.write_index(m.where("id > 2"), index)
    text_search.write_index(m.limit(0), index)
    for q, mode in (("cat", "and"), ("cat sat", "and"), ("dog cat cat", "or"), ("", "and"), ("none", "and"), ("sat-cat", "and"), ("cat-sat dog", "or"), ("foo-bar-baz bar", "and"), ("baz-bar", "and"), ("2026-02-27", "and")):
        want = [(r.id, round(r["rank"], 9)) for r in text_search.bm25(m, q, 10, mode).collect()]
        assert [(r.id, round(r["rank"], 9)) for r in text_search.index_search(spark, index, q, 10, mode).collect()] == want
        assert [(r.id, r.content, round(r["rank"], 9)) for r in text_search.bm25(m, q, 10, mode, index).collect()] == [(i, m.where(F.col("id") == i).first().content, x) for i, x in want]


def plans_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hydration_does_not_sort_memories(spark):
    m = memories(spark, "cat sat", "dog")
    got = fusion.hydrate(fusion.rrf([leg(spark, "vector", *[r.content_hash for r in m.collect()], "other")]), m)
    assert "SortMergeJoin" not in plans_of(got)
    assert sorted(r.content for r in got.collect()) == ["cat sat", "dog", "other"]


def test_knn(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.9, 0.1]), ("d", None)], "content_hash string, embedding array<double>")
    got = vector_search.knn(v, [1.0, 0.0], 2).collect()
    assert [r.content_hash for r in got] == ["a", "c"] and got[0].distance < 0.01
    assert [r.content_hash for r in vector_search.knn(v, [0.0, 2.0], 1, "cosine").collect()] == ["b"]
    with pytest.raises(ValueError):
        vector_search.knn(v, [1.0], 1, "manhattan")


def leg(spark, source, *hashes):
    rows = [(h, DAY if source == "bm25" else None, "", None, 1.0 - i / 10, source, h if h[0] != "!" else "", None, f"{i:03d}") for i, h in enumerate(hashes)]
    return spark.createDataFrame(rows, "content string, date date, mood string, ts timestamp, score double, source string, content_hash string, event_time date, __tie string")


def test_rrf(spark):
    got = fusion.rrf([leg(spark, "bm25", "s", "b"), leg(spark, "vector", "s", "v")], limit=3).collect()
    assert [(r.content_hash, r.source, r["rank"]) for r in got] == [("s", "bm25", 1), ("b", "bm25", 2), ("v", "vector", 3)]
    assert got[0].score == pytest.approx(2 / 61) and got[1].score == pytest.approx(1 / 62)
    assert fusion.rrf([leg(spark, "bm25", "s")], limit=0).count() == 0
    assert [r.content for r in fusion.rrf([leg(spark, "graph", "!x", "!x")]).collect()] == ["!x"]


def test_rrf_does_not_depend_on_row_order(spark):
    a, b = leg(spark, "bm25", *"abcdefg"), leg(spark, "vector", *"gfedxyz")
    want = fusion.rrf([a, b]).collect()
    assert fusion.rrf([a.repartition(5), b.orderBy("content")]).collect() == want


def test_date_filter_keeps_unknown_and_hydrate_keeps_orphans(spark):
    m = memories(spark, "first", "second")
    fused = fusion.rrf([leg(spark, "bm25", "h1"), leg(spark, "vector", "h2", "gone")])
    assert {r.content_hash for r in fusion.date_filter(fused, date(2027, 1, 1), None).collect()} == {"h2", "gone"}
    assert {r.content_hash: r.content for r in fusion.hydrate(fused, m).collect()} == {"h1": "first", "h2": "second", "gone": "gone"}


# --- graph


def star(spark, n):
    return edges(spark, *[("Hub", f"L{i}") for i in range(n)], *[(f"L{i}", f"G{i}") for i in range(n)])


@pytest.mark.parametrize(("leaves", "reaches"), [(16, False), (15, True), (5, True)])
def test_hubs_go_one_hop(spark, leaves, reaches):
    t = graph.traverse(star(spark, leaves), no_aliases(spark), "hub", 2, 100)
    assert any(n.startswith("g") for n in t.nodes) is reaches


def test_traverse_limits_edges_and_follows_aliases(spark):
    e = edges(spark, ("A", "B", "R", 0.1), ("A", "C", "R", 0.9), ("Z", "D"), ("B", "Q", "R", 0.5, "", "", DAY))
    al = spark.createDataFrame([(1, "Z", "a")], "id long, alias string, canonical string")
    t = graph.traverse(e, al, "a", 2, 10)
    assert [(x.source, x.target) for x in t.edges] == [("A", "C"), ("A", "B"), ("Z", "D")]
    assert [(x.source, x.target) for x in graph.traverse(e, al, "a", 2, 1).edges] == [("A", "C")]
    assert len(graph.traverse(e, al, "A", 2, 10, include_historical=True).edges) == 4
    assert graph.traverse(e, al, "nobody").edges == []


def test_degree_and_k_hop(spark):
    e = edges(spark, ("A", "B"), ("a", "a"), ("B", "C", "R", 0.5, "", "", DAY))
    assert {r.node: r.degree for r in graph.degrees(e).collect()} == {"a": 2, "b": 2, "c": 1} and graph.degree(e, "A") == 2
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.depth for r in graph.k_hop(e, seeds, 3).collect()} == {"a": 0, "b": 1, "c": 2}


def test_find_path(spark):
    e = edges(spark, ("A", "B"), ("C", "b"), ("C", "D"), ("X", "Y"), ("A", "D", "R", 0.5, "", "", DAY))
    assert graph.find_path(e, "a", "D") == ["a", "B", "C", "D"]
    assert graph.find_path(e, "a", "D", include_historical=True) == ["a", "D"]
    assert graph.find_path(e, "A", "Y") == [] and graph.find_path(e, "Q", "q") == ["Q"]


def test_paths_have_no_bound(spark):
    e = spark.createDataFrame([(i, f"n{i}", f"n{i + 1}", None) for i in range(70)], "id long, source string, target string, valid_until date")
    assert graph.find_path(e, "N0", "n70") == ["N0", *[f"n{i}" for i in range(1, 71)]]
    far = graph.shortest_path_lengths(e.where("id < 15"), "n0")
    assert {r.node: r.depth for r in far.collect()} == {f"n{i}": i for i in range(16)}


def test_words_are_looked_up_together(spark):
    rows = [(1, "Anna Lee", 5), (2, "Anna", 2), (3, "Joanna", 9), (4, "the anna x", 1), (5, "Bob", 7), (6, "a.b Bob", 1)]
    n = spark.createDataFrame(rows, "id long, name string, mention_count long")
    words = ["anna", "bob", "a.b", "lee", "none", "a_na"]
    for limit in (1, 2, 5):
        want = [(i, r.name) for i, w in enumerate(words) for r in graph.search_nodes(n, w, limit).where(text.whole_word(F.col("name"), w)).collect()]
        assert [(r.word_no, r.name) for r in graph.search_words(n, words, limit).collect()] == want
    assert graph.search_words(n, [], 5).count() == 0


def test_search_nodes(spark):
    n = nodes(spark, ("Anna", "P", 1), ("Anna Lee", "P", 9), ("Joanna", "P", 5), ("the anna x", "P", 3))
    assert [r.name for r in graph.search_nodes(n, "anna").collect()] == ["Anna", "Anna Lee", "the anna x", "Joanna"]
    assert [r.name for r in graph.search_nodes(n, "anna", 1).collect()] == ["Anna Lee"]
    assert [r.name for r in graph.search_nodes(n, "a_na", 10).collect()] and graph.top_entity(n).first().name == "Anna Lee"


def scores(df):
    return {r.node: r.score for r in df.collect()}


def test_pagerank(spark):
    e = edges(spark, ("A", "B"), ("B", "C"))
    s = scores(pagerank.personalized_pagerank(e, ["A"]))
    assert s["b"] > s["c"] and sum(s.values()) <= 1 + 1e-9
    s = scores(pagerank.personalized_pagerank(edges(spark, ("root", "heavy", "R", 0.9), ("root", "light", "R", 0.1)), ["root"]))
    assert s["heavy"] > s["light"]
    assert scores(pagerank.personalized_pagerank(e, ["Ghost"])) == {"ghost": 1.0}
    old = edges(spark, ("A", "B", "R", 0.5, "", "", DAY))
    assert scores(pagerank.personalized_pagerank(old, ["A"])) == {} and "b" in scores(pagerank.personalized_pagerank(old, ["A"], include_historical=True))


def test_pagerank_by_hand(spark):
    """Ten rounds of the recurrence, with a loop, parallel edges, weights of 0, and a lost seed share."""
    rows = [("A", "B", "R", 0.0), ("A", "b", "S", 0.5), ("C", "C", "R", 0.25), ("B", "C", "R", 0.75), ("D", "E")]
    adj = {}
    for s, t, w in [(r[0].lower(), r[1].lower(), (r[3] if len(r) > 3 else 0.5) or 1.0) for r in rows]:
        adj.setdefault(s, []).append((t, w))
        adj.setdefault(t, []).append((s, w))
    p = dict.fromkeys(adj, 1 / len(adj))
    for _ in range(10):
        q = {k: 0.15 / 2 if k == "a" else 0.0 for k in adj}
        for k, v in p.items():
            for t, w in adj[k]:
                q[t] += 0.85 * v * w / sum(x for _, x in adj[k])
        p = q
    assert scores(pagerank.personalized_pagerank(edges(spark, *rows), ["A", "a"])) == pytest.approx(p)


def test_memories_reached_from_several_seeds_rank_first(spark):
    e = edges(spark, ("A", "S", "R", 0.5, "shared"), ("B", "S", "R", 0.5, "shared"), ("A", "X", "R", 0.5, "other"), ("A", "Y", "R", 0.5, "", "loose"))
    got = pagerank.ppr_memories(e, pagerank.personalized_pagerank(e, ["A", "B"])).collect()
    assert got[0].content_hash == "shared" and {r.content_hash or r.content for r in got} == {"shared", "other", "loose"}


def test_communities(spark):
    e = edges(spark, ("A", "b"), ("B", "C"), ("b", "A", "S"), ("C", "C"), ("P", "Q"))
    n = nodes(spark, ("A", "PERSON"), ("B", "PERSON"), ("C", "ORG"), ("Lone", ""))
    got = communities.numbered(communities.communities(n, e)).orderBy("cluster_id").collect()
    assert [(r.label, r.entity_count, r.edge_count) for r in got] == [("PERSON", 3, 2), ("UNKNOWN", 1, 0)]
    table = communities.cluster_table(n, e)
    assert [r.entity_name for r in communities.cluster_members(table, "PERSON").collect()] == ["A", "B", "C"]
    assert [r.entity_count for r in communities.cluster_list(table).collect()] == [3, 1]


# --- resolution and time


def test_scan_and_find_similar(spark):
    names = spark.createDataFrame([("Anna Lee", 3, [1.0, 0.0]), ("anna lee!", 1, [1.0, 0.01]), ("Bob Stone", 2, [0.97, 0.25]), ("x", 9, [1.0, 0.0]), (" ", 1, [1.0, 0.0])], "name string, mention_count long, embedding array<double>")
    got = {(r.source, r.target): r.decision for r in resolve.scan_all(names).collect()}
    assert got == {("Anna Lee", "anna lee!"): "auto", ("Anna Lee", "Bob Stone"): "candidate", ("Bob Stone", "anna lee!"): "candidate"}
    assert {r.target: r.decision for r in resolve.find_similar(names, "anna LEE", [1.0, 0.0]).collect()} == {"anna lee!": "auto", "Bob Stone": "candidate"}


def test_pair_blocks_meet_every_pair_once(spark):
    names = spark.createDataFrame([(f"name{i:04d}", i % 7, [1.0]) for i in range(90)], "name string, mention_count long, embedding array<double>")
    got = [tuple(sorted(r[:2])) for r in resolve.pair_blocks(names, per_key=4).collect()]
    assert len(got) == len(set(got)) == 90 * 89 // 2


def test_merge(spark):
    e = edges(spark, ("A", "X"), ("B", "X"), ("a", "B"), ("B", "B"), ("C", "A"))
    assert sorted((r.source, r.target) for r in resolve.merge_edges(e, "A", "B").collect()) == [("B", "B"), ("B", "X"), ("C", "B")]
    log = spark.createDataFrame([], "source_name string, target_name string, merge_type string, vector_sim double, name_sim double, ts timestamp")
    tables = {"nodes": nodes(spark, ("A", "P", 3), ("B", "P", 4)), "edges": e, "aliases": no_aliases(spark), "merge_log": log}
    after, status = resolve.merge_entities(tables, "a", "B", datetime(2026, 1, 1))
    assert status["status"] == "merged" and {r.name: r.mention_count for r in after["nodes"].collect()} == {"B": 7}
    assert [(r.alias, r.canonical) for r in after["aliases"].collect()] == [("a", "B")] and after["merge_log"].count() == 1
    assert resolve.merge_entities(tables, "A", "a", datetime(2026, 1, 1))[1]["reason"] == "self-merge"
    assert resolve.merge_entities(after, "A", "B", datetime(2026, 1, 1))[1]["reason"] == "source not found"
    assert resolve.merge_entities(after, "B", "Z", datetime(2026, 1, 1))[1]["reason"] == "target not found"


def log(spark, *rows):
    return spark.createDataFrame([("A", "B", "R", float(x), f"e{i}", f"h{i}", date(2026, 1, 1 + i), i) for i, x in enumerate(rows)], "source string, target string, rel_type string, weight double, evidence string, source_hash string, event_time date, seq int")


@pytest.mark.parametrize("values", [(1.0,), (1.0, 0.0), (0.2, 0.9, 0.4, 0.7)])
def test_fold_is_the_ordered_mean(spark, values):
    want = values[0]
    for x in values[1:]:
        want = (want + x) / 2
    got = temporal.fold_edges(log(spark, *values)).first()
    assert got.weight == pytest.approx(want) and got.evidence == f"e{len(values) - 1}" and got.valid_from == date(2026, 1, 1)


def test_upsert_onto_what_is_there(spark):
    first = temporal.fold_edges(log(spark, 0.2, 0.9)).withColumns({"id": F.lit(1), "valid_until": F.lit(DAY)}).drop("assertions")
    got = temporal.upsert_edges(first, log(spark, 0.4, 0.7)).first()
    assert got.weight == pytest.approx(temporal.fold_edges(log(spark, 0.2, 0.9, 0.4, 0.7)).first().weight) and got.valid_until == DAY and got.id == 1


def test_fold_nodes(spark):
    rows = [("A", "X", date(2026, 1, 1), 0.5, 1), ("A", "", date(2026, 1, 3), 0.9, 3), ("A", "Y", date(2026, 1, 2), 0.1, 2)]
    got = temporal.fold_nodes(spark.createDataFrame(rows, "name string, type string, date date, confidence double, seq int")).first()
    assert (got.type, got.mention_count, got.first_seen, got.last_seen, got.confidence) == ("Y", 3, date(2026, 1, 1), date(2026, 1, 3), 0.9)


def test_invalidate(spark):
    e = edges(spark, ("A", "B"), ("C", "b"), ("A", "D"))
    after, hit = temporal.invalidate_edges(e, DAY, target="B")
    assert e.where(hit).count() == 2 and temporal.current(after).count() == 1 and temporal.current(after, True).count() == 3
    assert e.where(temporal.invalidate_edges(e, DAY)[1]).count() == 0


def test_decay_rows(spark):
    e = edges(spark, ("A", "B", "R", 0.8), ("A", "C", "R", 0.8, "", "", DAY), ("A", "D", "R", 0.05), ("A", "E", "R", 0.8)).withColumn("last_reinforced", F.when(F.col("target") != "E", F.lit(date(2026, 1, 28))))
    got = {r.target: (r.old_weight, r.new_weight, r.days_since_reinforced) for r in temporal.decay(e, DAY, 30).collect()}
    assert got == {"B": (0.8, 0.4, 30), "D": (0.05, 0.1, 30)}
    assert temporal.decay(e, DAY, 0).count() == 0 and temporal.decay(e, date(2026, 1, 28), 30).count() == 0


def test_timeline(spark):
    m = memories(spark, "a", "b", "c", dates={0: date(2026, 1, 15), 1: date(2026, 2, 20), 2: date(2026, 3, 10)})
    assert [r.content for r in timeline.timeline(m, date(2026, 1, 20), date(2026, 2, 28)).collect()] == ["b"]
    assert [r.content for r in timeline.timeline(m, limit=2).collect()] == ["b", "c"]
    assert timeline.timeline(m, sort_by="event_time").count() == 0 and timeline.dates(m).count() == 3
    assert [r.content for r in timeline.stale(m, date(2026, 3, 20), 30).collect()] == ["a"]


def tables(spark):
    m = memories(spark, "anna met bob in paris", "bob likes tea", "rain in paris", "nothing else")
    e = edges(spark, ("Anna", "Bob", "KNOWS", 0.9, "h1", "anna met bob"), ("Bob", "Tea", "LIKES", 0.5, "h2", "tea"), ("Anna", "Paris", "IN", 0.7, "h1"), ("Me", "Anna", "KNOWS", 0.4, "h4"))
    n = nodes(spark, ("Me", "PERSON", 50), ("Anna", "PERSON", 5), ("Bob", "PERSON", 3), ("Tea", "TOPIC", 1), ("Paris", "PLACE", 2))
    return search.Tables(m, n, e, no_aliases(spark), m.select("content_hash", fake_embedding("content", 16).alias("embedding")))


def test_search_plain_and_by_entity(spark):
    t = tables(spark)
    q = spark.range(1).select(fake_embedding(F.lit("bob likes tea"), 16)).first()[0]
    plain = search.search_memories(t, "bob tea", q, 3).collect()
    assert plain[0].content == "bob likes tea" and plain[0].source == "bm25"
    named = search.search_memories(t, "who", q, 5, entities=["Anna", "Paris"]).collect()
    assert named[0].content_hash == "h1" and all(r.source != "vector" for r in named)
    assert search.search_memories(t, "bob tea", q, 3, date_from=date(2030, 1, 1)).where("source = 'bm25'").count() == 0
    assert search.seeds(t.nodes, "the me anna") == ["Anna"] and search.seeds(t.nodes, "me") == ["Me"]


def test_recall_context_and_connection(spark):
    t = tables(spark)
    r = search.recall_entity(t, "anna")
    assert r["connected_count"] == 5 and {m["content_hash"] for m in r["source_memories"]} == {"h1", "h2", "h4"}
    c = search.graph_context(t, ["Anna"], ["h1"], 19)
    assert len(c["evidence"]) == 1 and c["evidence"][0]["evidence"] == "bob likes tea"
    x = search.explain_connection(t, "Anna", "Tea")
    assert x["connected"] and x["paths"] == [["Anna", "Bob", "Tea"]] and [m["content_hash"] for m in x["source_memories"]] == ["h1", "h2"]
    assert not search.explain_connection(t, "Anna", "Mars")["connected"]
