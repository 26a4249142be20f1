"""Named queries over the driver's tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions import similarity, temporal
from quernel.functions.text import STOP_WORDS, accent_table, csv_list, joined_list, nocase, seed_words, term_fold, terms
from quernel.operators import communities, fusion, graph, pagerank, resolve, search, text_search, timeline, vector_search
from quernel.operators import temporal as history
from quernel.sources import views
from quernel.sources.views import with_views
from quernel.streaming import extensions
from quernel.workspace import read_table

AS_OF = date(1999, 1, 1)
MEMORY_DAY = date(2025, 1, 15)
ANY_OF = "idiot moron trash loser"
ALL_OF = "the then"
PHRASE = "of-the"
SEEDS = ["Customer#10", "NATION_7"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- text ---------------------------------------------------------------------------------------

_A, _B = accent_table()


def _tokens(what: str) -> str:
    return rf"regexp_extract_all(translate(lower(coalesce({what}, '')), '{_A}', '{_B}'), '[\p{{L}}\p{{N}}\p{{Co}}]+')"


_CUT = f"""cut AS (SELECT id, content, date, mood, content_hash, {_tokens('content')} AS c, {_tokens("strftime(date, '%Y-%m-%d')")} AS d, {_tokens('mood')} AS m FROM memories_v)"""


def _bm25_body(words: list[str], mode: str, limit: int) -> str:
    hits = ", ".join(f"len(list_filter(c, lambda x: x = '{w}')) + len(list_filter(d, lambda x: x = '{w}')) + len(list_filter(m, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(words))
    counts = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(words)))
    idf = [f"CASE WHEN ln((total - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((total - n{i} + 0.5) / (n{i} + 0.5)) END" for i in range(len(words))]
    rank = " + ".join(f"CASE WHEN f{i} > 0 THEN ({idf[i]}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / average)) ELSE 0 END" for i in range(len(words)))
    test = (" AND " if mode == "and" else " OR ").join(f"f{i} > 0" for i in range(len(words)))
    return f"""WITH {_CUT}, f AS (SELECT *, len(c) + len(d) + len(m) AS len, {hits} FROM cut),
s AS (SELECT count(*) AS total, sum(len) / count(*) AS average, {counts} FROM f),
ranked AS (SELECT id, content_hash, {rank} AS rank FROM f CROSS JOIN s WHERE {test} ORDER BY rank DESC, id LIMIT {limit})
"""


def _bm25_sql(words: list[str], mode: str, limit: int) -> str:
    return with_views(_bm25_body(words, mode, limit), "memories_v")


def _memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.memories(spark, sf_dir)


@query(_bm25_sql(ANY_OF.split(), "or", 10) + "SELECT id, content_hash, round(rank, 6) AS rank FROM ranked")
def bm25_topk(spark, sf_dir):
    return text_search.bm25(_memories(spark, sf_dir), ANY_OF, 10, "or").select("id", "content_hash", F.round("rank", 6).alias("rank"))


@query(_bm25_sql(ALL_OF.split(), "and", 20) + "SELECT id, round(CASE WHEN max(rank) OVER () > 0 THEN rank / max(rank) OVER () ELSE 1 END, 6) AS score FROM ranked")
def bm25_normalised(spark, sf_dir):
    return text_search.normalised(text_search.bm25(_memories(spark, sf_dir), ALL_OF, 20)).select("id", F.round("score", 6).alias("score"))


@query(_bm25_sql(["the", "idiot"], "and", 1_000_000) + "SELECT id FROM ranked")
def fts_and_match(spark, sf_dir):
    counted = text_search.match_counts(_memories(spark, sf_dir), text_search.phrases("the idiot"))
    return counted.where("f0 > 0 AND f1 > 0").select("id")


@query(_bm25_sql(ANY_OF.split(), "or", 10) + "SELECT id, content_hash, round(rank, 6) AS rank FROM ranked")
def bm25_index(spark, sf_dir):
    """The same as ``bm25_topk``, from the stored index."""
    return text_search.bm25(_memories(spark, sf_dir), ANY_OF, 10, "or", views.text_index(spark, sf_dir)).select("id", "content_hash", F.round("rank", 6).alias("rank"))


@query(with_views(f"WITH {_CUT} SELECT id, CAST(len(list_filter(range(1, len(c)), lambda i: c[i] = 'of' AND c[i + 1] = 'the')) AS BIGINT) AS hits FROM cut WHERE len(list_filter(range(1, len(c)), lambda i: c[i] = 'of' AND c[i + 1] = 'the')) > 0", "memories_v"))
def fts_phrase_index(spark, sf_dir):
    counted = text_search.index_counts(spark, views.text_index(spark, sf_dir), text_search.phrases(PHRASE))
    return counted.where("f0 > 0").select("id", F.col("f0").alias("hits"))


@query(with_views(f"WITH {_CUT} SELECT id, CAST(len(list_filter(range(1, len(c)), lambda i: c[i] = 'of' AND c[i + 1] = 'the')) AS BIGINT) AS hits FROM cut WHERE len(list_filter(range(1, len(c)), lambda i: c[i] = 'of' AND c[i + 1] = 'the')) > 0", "memories_v"))
def fts_phrase(spark, sf_dir):
    counted = text_search.match_counts(_memories(spark, sf_dir), text_search.phrases(PHRASE))
    return counted.where("f0 > 0").select("id", F.col("f0").cast("long").alias("hits"))


@query(with_views(f"WITH {_CUT}, t AS (SELECT id, unnest(c || d || m) AS term FROM cut) SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM t GROUP BY 1", "memories_v"))
def term_stats(spark, sf_dir):
    return text_search.term_stats(text_search.term_rows(_memories(spark, sf_dir)))


@query(f"SELECT doc_id, translate(lower(text), '{_A}', '{_B}') AS folded, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS nocase, CAST(len({_tokens('text')}) AS INTEGER) AS n_terms FROM documents")
def text_folds(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", term_fold("text").alias("folded"), nocase("text").alias("nocase"), F.size(terms("text")).alias("n_terms"))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query(f"SELECT conv_id, turn, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 2 AND w NOT IN ({_STOP})))) AS words FROM conversations")
def seed_terms(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_sort(seed_words(F.col("text"))).alias("words"))


# --- vectors ------------------------------------------------------------------------------------

_Q = "q AS (SELECT embedding AS q FROM vectors_v WHERE vec_id = 0)"
_L2 = "sqrt(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (embedding[i] - q[i]) * (embedding[i] - q[i]))))"
_COS = "list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i] * q[i])) / (sqrt(list_sum(list_transform(embedding, lambda x: x * x))) * sqrt(list_sum(list_transform(q, lambda x: x * x))))"


def _query_vector(v: DataFrame) -> list[float]:
    return v.where("vec_id = 0").first().embedding


@query(with_views(f"WITH {_Q} SELECT vec_id, round({_L2}, 6) AS distance FROM vectors_v CROSS JOIN q ORDER BY {_L2}, vec_id LIMIT 20", "vectors_v"))
def knn_l2(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    return vector_search.knn(v, _query_vector(v), 20, tie="vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query(with_views(f"WITH {_Q} SELECT vec_id, round(1 - {_COS}, 6) + 0 AS distance FROM vectors_v CROSS JOIN q ORDER BY {_COS} DESC, vec_id LIMIT 20", "vectors_v"))
def knn_cosine(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    return vector_search.knn(v, _query_vector(v), 20, "cosine", "vec_id").select("vec_id", (F.round("distance", 6) + 0).alias("distance"))


@query(with_views(f"WITH {_Q} SELECT content_hash, round(greatest(0, 1 - {_L2} / 2), 6) AS score FROM vectors_v CROSS JOIN q ORDER BY {_L2}, content_hash LIMIT 20", "vectors_v"))
def vector_score(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    return vector_search.vector_search(v, _query_vector(v), 20).select("content_hash", F.round("score", 6).alias("score"))


@query("SELECT doc_id, list_transform(range(0, 128), lambda i: (CAST('0x' || sha256(text)[i % 64 + 1] AS INTEGER) - 8) / 8.0) AS embedding FROM documents")
def fake_embed(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", similarity.fake_embedding("text", 128).alias("embedding"))


# --- fusion -------------------------------------------------------------------------------------


def _legs(spark, sf_dir):
    """Two text legs and a vector leg over contents' fake vectors."""
    m = _memories(spark, sf_dir)
    v = m.select("content_hash", similarity.fake_embedding("content", 64).alias("embedding"))
    q = v.where("content_hash IS NOT NULL").orderBy("content_hash").first().embedding
    return m, [text_search.bm25_search(m, ANY_OF, 30, "or").withColumn("__tie", F.lpad("__tie", 20, "0")), vector_search.vector_search(v, q, 30)]


_FAKE = "list_transform(range(0, 64), lambda i: (CAST('0x' || content_hash[i % 64 + 1] AS INTEGER) - 8) / 8.0)"


def _rrf_sql(words: list[str], limit: int) -> str:
    return _bm25_sql(words, "or", 30) + f""", bm AS (SELECT content_hash, row_number() OVER (ORDER BY rank DESC, id) AS p FROM ranked),
fv AS (SELECT content_hash, {_FAKE} AS embedding FROM memories_v), fq AS (SELECT embedding AS q FROM fv ORDER BY content_hash LIMIT 1),
vd AS (SELECT content_hash, {_L2} AS dist FROM fv CROSS JOIN fq ORDER BY dist, content_hash LIMIT 30),
ve AS (SELECT content_hash, row_number() OVER (ORDER BY greatest(0, 1 - dist / 2) DESC, content_hash) AS p FROM vd),
u AS (SELECT content_hash, p, 0 AS leg FROM bm UNION ALL SELECT content_hash, p, 1 FROM ve),
g AS (SELECT content_hash, round(sum(1.0 / (60 + p)), 12) AS s, min(leg * 1000 + p) AS first FROM u GROUP BY 1),
fused AS (SELECT content_hash, s, CASE WHEN first < 1000 THEN 'bm25' ELSE 'vector' END AS source, row_number() OVER (ORDER BY s DESC, first) AS rank FROM g ORDER BY s DESC, first LIMIT {limit})
"""


_RRF = _rrf_sql(ANY_OF.split(), 15)


@query(_RRF + "SELECT content_hash, round(s, 6) AS score, source, CAST(rank AS INTEGER) AS rank FROM fused")
def rrf_fuse(spark, sf_dir):
    return fusion.rrf(_legs(spark, sf_dir)[1], limit=15).select("content_hash", F.round("score", 6).alias("score"), "source", "rank")


@query(_RRF + "SELECT f.content_hash, f.source, CAST(rank AS INTEGER) AS rank FROM fused f JOIN memories_v m USING (content_hash) WHERE source = 'vector' OR coalesce(event_time, date) BETWEEN DATE '2024-03-01' AND DATE '2024-09-30'")
def rrf_date_filter(spark, sf_dir):
    fused = fusion.rrf(_legs(spark, sf_dir)[1], limit=15)
    return fusion.date_filter(fused, date(2024, 3, 1), date(2024, 9, 30)).select("content_hash", "source", "rank")


@query(_RRF + "SELECT content_hash, m.content, m.date, m.mood, m.event_time, source, CAST(rank AS INTEGER) AS rank FROM fused JOIN memories_v m USING (content_hash)")
def hydrate(spark, sf_dir):
    m, legs = _legs(spark, sf_dir)
    return fusion.hydrate(fusion.rrf(legs, limit=15), m).select("content_hash", "content", "date", "mood", "event_time", "source", "rank")


def _tables(spark, sf_dir) -> search.Tables:
    m = _memories(spark, sf_dir)
    v = m.select("content_hash", similarity.fake_embedding("content", 64).alias("embedding"))
    return search.Tables(m, views.nodes(spark, sf_dir), views.edges(spark, sf_dir), views.aliases(spark, sf_dir), v)


#: Current edges once for each end, numbered per node by falling weight.
_NEAR = """ends AS (SELECT lower(source) AS node, * FROM edges_v WHERE valid_until IS NULL UNION ALL SELECT lower(target), * FROM edges_v WHERE valid_until IS NULL AND lower(source) <> lower(target)),
near AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, id) AS p FROM ends)"""


def _hybrid_sql(legs: str, limit: int) -> str:
    """The fusion of legs bm(content_hash, p), ve(..) and gr(content, content_hash, p), hydrated."""
    return f"""{legs},
u AS (SELECT content_hash, p, 0 AS leg, NULL AS content FROM bm UNION ALL SELECT content_hash, p, 1, NULL FROM ve UNION ALL SELECT content_hash, p, 2, content FROM gr),
g AS (SELECT content_hash, round(sum(1.0 / (60 + p)), 12) AS s, min(leg * 1000 + p) AS first, any_value(content) AS own FROM u GROUP BY 1),
fused AS (SELECT content_hash, s, own, CASE WHEN first < 1000 THEN 'bm25' WHEN first < 2000 THEN 'vector' ELSE 'graph' END AS source, row_number() OVER (ORDER BY s DESC, first) AS rank FROM g ORDER BY s DESC, first LIMIT {limit})
SELECT CASE WHEN m.content_hash IS NULL THEN own ELSE m.content END AS content, m.date, CASE WHEN m.content_hash IS NULL THEN '' ELSE m.mood END AS mood, m.event_time, round(s, 4) AS score, source, f.content_hash, CAST(rank AS INTEGER) AS rank
FROM fused f LEFT JOIN memories_v m USING (content_hash)"""


_VECTOR_LEG = f"""bm AS (SELECT content_hash, row_number() OVER (ORDER BY rank DESC, id) AS p FROM ranked),
fv AS (SELECT content_hash, {_FAKE} AS embedding FROM memories_v), fq AS (SELECT embedding AS q FROM fv ORDER BY content_hash LIMIT 1),
vd AS (SELECT content_hash, {_L2} AS dist FROM fv CROSS JOIN fq ORDER BY dist, content_hash LIMIT 30),
ve AS (SELECT content_hash, row_number() OVER (ORDER BY greatest(0, 1 - dist / 2) DESC, content_hash) AS p FROM vd)"""


#: The five best mentioned suppliers are seeds, and hubs: each leads to its 50 heaviest edges only.
_HYBRID = f"""{_bm25_body(["supplier", "idiot"], "or", 30)},
{_VECTOR_LEG},
{_NEAR},
seed AS (SELECT lower(name) AS node, row_number() OVER (ORDER BY mention_count DESC, id) AS no FROM nodes_v WHERE type = 'ORGANIZATION' ORDER BY mention_count DESC, id LIMIT 5),
walk AS (SELECT evidence, source_hash, weight, no, p FROM seed JOIN near USING (node) WHERE p <= 30),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_hash ORDER BY no, p) AS n FROM walk) WHERE n = 1),
gr AS (SELECT evidence AS content, source_hash AS content_hash, row_number() OVER (ORDER BY weight DESC, no, p) AS p FROM once ORDER BY weight DESC, no, once.p LIMIT 30)"""


@query(with_views(_hybrid_sql(_HYBRID, 10), "memories_v", "edges_v", "nodes_v"))
def hybrid_search(spark, sf_dir):
    t = _tables(spark, sf_dir)
    q = t.vectors.orderBy("content_hash").first().embedding
    return search.search_memories(t, "Supplier, idiot!", q, limit=10, mode="or", as_of=MEMORY_DAY)


# --- timeline and catalogue ---------------------------------------------------------------------


@query(with_views("SELECT id, date, content_hash FROM memories_v WHERE date BETWEEN DATE '2024-02-01' AND DATE '2024-10-31' ORDER BY date DESC, id DESC LIMIT 50", "memories_v"))
def timeline_processing(spark, sf_dir):
    return timeline.timeline(_memories(spark, sf_dir), date(2024, 2, 1), date(2024, 10, 31)).select("id", "date", "content_hash")


@query(with_views("SELECT id, event_time, tags FROM memories_v WHERE event_time >= DATE '2024-01-15' ORDER BY event_time DESC, id DESC LIMIT 50", "memories_v"))
def timeline_event(spark, sf_dir):
    return timeline.timeline(_memories(spark, sf_dir), date(2024, 1, 15), None, sort_by="event_time").select("id", "event_time", "tags")


@query(with_views("SELECT DISTINCT date FROM memories_v", "memories_v"))
def memory_dates(spark, sf_dir):
    return timeline.dates(_memories(spark, sf_dir))


@query(with_views("SELECT count(*) AS memories FROM memories_v", "memories_v"))
def memory_count(spark, sf_dir):
    return _memories(spark, sf_dir).agg(F.count("*").alias("memories"))


@query("SELECT min(doc_id) AS id, sha256(text) AS content_hash FROM documents GROUP BY 2")
def dedup_by_hash(spark, sf_dir):
    saves = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"))
    return timeline.first_by_hash(saves).select("id", "content_hash")


@query(with_views("WITH top AS (SELECT * FROM nodes_v ORDER BY mention_count DESC, name LIMIT 50) SELECT name, type, mention_count, confidence, array_to_string(list_sort(list(alias) FILTER (alias IS NOT NULL)), '|||') AS aliases FROM top LEFT JOIN aliases_v ON lower(canonical) = lower(name) GROUP BY ALL", "nodes_v", "aliases_v"))
def top_entities_with_aliases(spark, sf_dir):
    found = timeline.entities_with_aliases(views.nodes(spark, sf_dir), views.aliases(spark, sf_dir))
    return found.withColumn("aliases", F.when(F.size("aliases") > 0, F.concat_ws("|||", "aliases")))


@query("SELECT * FROM (VALUES ('năm nay', DATE '2025-01-01', DATE '2025-12-31'), ('tháng 2/2024', DATE '2024-02-01', DATE '2024-02-29'), ('in 2019 x', DATE '2019-01-01', DATE '2019-12-31'), ('năm ngoái', DATE '2024-01-01', DATE '2024-12-31'), ('none', NULL, NULL)) t(q, start, stop)")
def temporal_range(spark, sf_dir):
    asked = spark.createDataFrame([(q,) for q in ("năm nay", "tháng 2/2024", "in 2019 x", "năm ngoái", "none")], "q string")
    return asked.withColumn("r", temporal.temporal_range(F.col("q"), F.lit(MEMORY_DAY))).select("q", "r.start", "r.stop")


@query(with_views("SELECT id, date FROM memories_v WHERE date <= DATE '2025-01-15' - 30 ORDER BY date DESC, id DESC LIMIT 50", "memories_v"))
def stale_memories(spark, sf_dir):
    return timeline.stale(_memories(spark, sf_dir), MEMORY_DAY).select("id", "date")


@query("SELECT p_partkey, list_filter(list_transform(string_split(p_name || ', ' || p_brand || ' ,,', ','), lambda x: trim(x)), lambda x: x <> '') AS tags, list_filter(string_split(p_name || '|||' || p_type || '||||||', '|||'), lambda x: x <> '') AS names FROM part")
def list_parsing(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    return p.select("p_partkey", csv_list(F.concat("p_name", F.lit(", "), "p_brand", F.lit(" ,,"))).alias("tags"), joined_list(F.concat("p_name", F.lit("|||"), "p_type", F.lit("||||||"))).alias("names"))


# --- graph --------------------------------------------------------------------------------------


@query(with_views("""WITH cut AS (SELECT * FROM nodes_v WHERE lower(name) LIKE '%10%' AND confidence >= 0.6 ORDER BY mention_count DESC, id LIMIT 30)
SELECT name, mention_count, CASE WHEN lower(name) = '10' THEN 0 WHEN lower(name) LIKE '10 %' THEN 1 WHEN regexp_matches(name, '(^|[^0-9A-Za-z_])10([^0-9A-Za-z_]|$)') THEN 2 ELSE 3 END AS match FROM cut""", "nodes_v"))
def node_search_rerank(spark, sf_dir):
    return graph.search_nodes(views.nodes(spark, sf_dir), "10", 30, 0.6).select("name", "mention_count", "match")


@query(with_views("SELECT node, count(*) AS degree FROM (SELECT lower(source) AS node FROM edges_v UNION ALL SELECT lower(target) FROM edges_v WHERE lower(source) <> lower(target)) GROUP BY 1 HAVING count(*) > 15", "edges_v"))
def degree(spark, sf_dir):
    """The hubs, from which walks go one step only."""
    return graph.degrees(views.edges(spark, sf_dir)).where(F.col("degree") > graph.HUB_DEGREE)


@query(with_views("SELECT node, count(*) AS degree FROM (SELECT lower(source) AS node FROM edges_v UNION ALL SELECT lower(target) FROM edges_v) GROUP BY 1", "edges_v"))
def degree_all_edges(spark, sf_dir):
    return graph.degrees(views.edges(spark, sf_dir))


@query(with_views("SELECT name, mention_count FROM nodes_v ORDER BY mention_count DESC, id LIMIT 1", "nodes_v"))
def top_entity(spark, sf_dir):
    return graph.top_entity(views.nodes(spark, sf_dir)).select("name", "mention_count")


@query(with_views("""WITH n AS (SELECT name FROM nodes_v WHERE type IN ('REGION', 'PLACE') UNION ALL SELECT alias FROM aliases_v WHERE alias LIKE 'c%0'),
r AS (SELECT name, name AS resolved, 0 AS step FROM n UNION ALL SELECT name, canonical, 1 FROM n JOIN aliases_v ON lower(alias) = lower(name)),
d AS (SELECT * FROM r UNION ALL SELECT name, alias, 2 FROM r JOIN aliases_v ON lower(canonical) = lower(resolved))
SELECT name, resolved, step FROM (SELECT *, row_number() OVER (PARTITION BY name, lower(resolved) ORDER BY step, resolved) AS n FROM (SELECT DISTINCT * FROM d)) WHERE n = 1""", "nodes_v", "aliases_v"))
def resolve_names(spark, sf_dir):
    a = views.aliases(spark, sf_dir)
    n = views.nodes(spark, sf_dir).where("type IN ('REGION', 'PLACE')").select("name").union(a.where("alias LIKE 'c%0'").select("alias"))
    return graph.resolve_names(a, n)


_ADJ = "adj AS (SELECT lower(source) AS node, lower(target) AS other FROM {v} UNION SELECT lower(target), lower(source) FROM {v})"


@query(with_views(f"""WITH {_ADJ.format(v='edges_v')}, b AS (SELECT 'customer#10' AS node, 0 AS depth UNION SELECT other, depth + 1 FROM b JOIN adj USING (node) WHERE depth < 3)
SELECT node, min(depth) AS depth FROM b GROUP BY 1""", "edges_v", recursive=True))
def k_hop(spark, sf_dir):
    seeds = spark.createDataFrame([("customer#10",)], "node string")
    return graph.k_hop(views.edges(spark, sf_dir), seeds, 3)


@query(with_views(f"WITH {_NEAR} SELECT source, target, rel_type FROM near WHERE node = 'supplier#1' AND p <= 20", "edges_v"))
def traverse_hub_cap(spark, sf_dir):
    t = graph.traverse(views.edges(spark, sf_dir), views.aliases(spark, sf_dir), "Supplier#1", 2, 20)
    return spark.createDataFrame([(e.source, e.target, e.rel_type) for e in t.edges], "source string, target string, rel_type string")


_CURRENT = "e AS (SELECT * FROM edges_v WHERE valid_until IS NULL)"


@query(with_views(f"""WITH {_CURRENT}, {_ADJ.format(v='e')}, b AS (SELECT 'supplier#1' AS node, 0 AS depth UNION SELECT other, depth + 1 FROM b JOIN adj USING (node) WHERE depth < 8)
SELECT node, min(depth) AS depth FROM b GROUP BY 1""", "edges_v", recursive=True))
def shortest_path_len(spark, sf_dir):
    return graph.shortest_path_lengths(views.edges(spark, sf_dir), "Supplier#1")


def _path_sql(source: str, target: str, levels: int) -> str:
    """Breadth first by levels; each node keeps the way that comes first."""
    steps, seen = [f"l0 AS (SELECT '{source.lower()}' AS node, ['{source}'] AS names, '' AS way)"], []
    for i in range(1, levels + 1):
        seen.append(f"SELECT node FROM l{i - 1}")
        steps.append(f"l{i} AS (SELECT other AS node, arg_min(list_append(names, spelling), way || chr(1) || id) AS names, min(way || chr(1) || id) AS way FROM l{i - 1} JOIN adj USING (node) WHERE other NOT IN ({' UNION ALL '.join(seen)}) GROUP BY other)")
    found = " UNION ALL ".join(f"SELECT names, {i} AS d FROM l{i} WHERE node = '{target.lower()}'" for i in range(1, levels + 1))
    return f"""WITH {_CURRENT}, adj AS (SELECT lower(source) AS node, lower(target) AS other, target AS spelling, id FROM e UNION ALL SELECT lower(target), lower(source), source, id FROM e),
{", ".join(steps)}, best AS (SELECT names FROM ({found}) ORDER BY d LIMIT 1) SELECT unnest(range(0, len(names))) AS place, unnest(names) AS name FROM best"""


@query(with_views(_path_sql("Customer#1", "Customer#11", 4), "edges_v"))
def shortest_path(spark, sf_dir):
    path = graph.find_path(views.edges(spark, sf_dir), "Customer#1", "Customer#11")
    return spark.createDataFrame([(i, n) for i, n in enumerate(path)], "place long, name string")


@query(with_views(_path_sql("Customer#1", "MIDDLE EAST", 4).rsplit("SELECT unnest", 1)[0] + "SELECT count(*) > 0 AS connected, max(len(names)) AS names FROM best", "edges_v"))
def explain_connection(spark, sf_dir):
    found = search.explain_connection(_tables(spark, sf_dir), "Customer#1", "MIDDLE EAST")
    return spark.createDataFrame([(found["connected"], len(found["paths"][0]) if found["paths"] else None)], "connected boolean, names long")


def _ppr_sql(view: str, seeds: list[str] = SEEDS) -> str:
    names = ", ".join(f"'{s.lower()}'" for s in seeds)
    steps = ", ".join(
        f"s{i} AS (SELECT n.node, (CASE WHEN n.node IN (SELECT node FROM seed) THEN 0.15 / (SELECT count(*) FROM seed) ELSE 0 END) + 0.85 * coalesce(sum(p.score * a.w / o.out), 0) AS score FROM o n LEFT JOIN both_ways a ON a.other = n.node LEFT JOIN s{i - 1} p ON p.node = a.node LEFT JOIN o ON o.node = a.node GROUP BY n.node)"
        for i in range(1, 11)
    )
    return f"""WITH kept AS (SELECT lower(source) AS s, lower(target) AS t, CASE WHEN coalesce(weight, 0) = 0 THEN 1.0 ELSE weight END AS w FROM {view} WHERE valid_until IS NULL),
both_ways AS (SELECT s AS node, t AS other, w FROM kept UNION ALL SELECT t, s, w FROM kept), o AS (SELECT node, sum(w) AS out FROM both_ways GROUP BY 1),
seed AS (SELECT node FROM o WHERE node IN ({names})), s0 AS (SELECT node, 1.0 / (SELECT count(*) FROM o) AS score FROM o), {steps}"""


@query(with_views(_ppr_sql("edges_v") + " SELECT node, round(score, 9) AS score FROM s10 WHERE score > 0", "edges_v"))
def ppr_scores(spark, sf_dir):
    found = pagerank.personalized_pagerank(views.edges(spark, sf_dir), SEEDS)
    return found.select("node", F.round("score", 9).alias("score"))


def _best(nodes: int) -> str:
    return f"""top AS (SELECT node, score FROM s10 ORDER BY round(score, 12) DESC, node LIMIT {nodes}),
adj AS (SELECT lower(source) AS node, * FROM edges_v WHERE valid_until IS NULL UNION ALL SELECT lower(target), * FROM edges_v WHERE valid_until IS NULL AND lower(source) <> lower(target)),
near AS (SELECT top.node, score, id, evidence, source_hash, (CASE WHEN coalesce(weight, 0) = 0 THEN 1.0 ELSE weight END) * score AS value FROM top JOIN adj USING (node)),
first AS (SELECT *, row_number() OVER (PARTITION BY source_hash, node ORDER BY id) AS n FROM near)"""


@query(with_views(_ppr_sql("edges_v") + f""", {_best(40)}
SELECT source_hash AS content_hash, round(sum(value), 9) AS score FROM first WHERE n = 1 GROUP BY 1 ORDER BY round(sum(value), 12) DESC, 1 LIMIT 20""", "edges_v"))
def ppr_memories(spark, sf_dir):
    e = views.edges(spark, sf_dir)
    found = pagerank.ppr_memories(e, pagerank.personalized_pagerank(e, SEEDS), 20)
    return found.select("content_hash", F.round("score", 9).alias("score"))


#: Entity mode: the text leg finds no such phrase, the vector leg has no contents yet, so PageRank decides.
@query(with_views(_ppr_sql("edges_v", ["AFRICA", "MIDDLE EAST"]) + f""", {_best(60)},
bm AS (SELECT '' AS content_hash, 0 AS p WHERE false), ve AS (SELECT '' AS content_hash, 0 AS p WHERE false),
gr AS (SELECT content, content_hash, row_number() OVER (ORDER BY round(score, 12) DESC, content_hash) AS p FROM (SELECT arg_min(evidence, (-score, node, id)) AS content, source_hash AS content_hash, sum(value) AS score FROM first WHERE n = 1 GROUP BY 2 ORDER BY round(sum(value), 12) DESC, 2 LIMIT 30))""" + _hybrid_sql("", 10), "edges_v", "memories_v"))
def hybrid_search_entities(spark, sf_dir):
    t = _tables(spark, sf_dir)
    q = t.vectors.orderBy("content_hash").first().embedding
    return search.search_memories(t, "who sells to Customer#1", q, limit=10, entities=["AFRICA", "Middle East"])


#: A hub: its ten heaviest current edges.
@query(with_views(f"WITH {_NEAR} SELECT source, target, rel_type AS type FROM near WHERE node = 'customer#10' AND p <= 10", "edges_v"))
def recall_entity(spark, sf_dir):
    found = search.recall_entity(_tables(spark, sf_dir), "Customer#10")
    return spark.createDataFrame([(r["source"], r["target"], r["type"]) for r in found["relationships"]], "source string, target string, type string")


@query(with_views(f"""WITH {_NEAR}, walk AS (SELECT *, CASE node WHEN 'customer#10' THEN 0 ELSE 1 END AS leg FROM near WHERE node IN ('customer#10', 'supplier#1') AND p <= 20),
once AS (SELECT *, row_number() OVER (PARTITION BY source_hash ORDER BY weight DESC, leg, p) AS n FROM walk)
SELECT source, target, rel_type AS type, evidence FROM once WHERE n = 1 ORDER BY weight DESC, leg, p LIMIT 15""", "edges_v"))
def graph_context(spark, sf_dir):
    found = search.graph_context(_tables(spark, sf_dir), ["Customer#10", "Supplier#1"], [], 5)
    return spark.createDataFrame([(e["source"], e["target"], e["type"], e["evidence"]) for e in found["evidence"]], "source string, target string, type string, evidence string")


def _labels_sql(edges: str, rounds: int = 10) -> str:
    """The smallest name within ``2 ** rounds`` steps (rounds jump along labels), for components of any shape up to that size."""
    steps = ", ".join(
        f"""n{i} AS (SELECT p.node, least(p.label, coalesce(min(q.label), p.label)) AS label FROM p{i - 1} p LEFT JOIN ba ON ba.node = p.node LEFT JOIN p{i - 1} q ON q.node = ba.other GROUP BY p.node, p.label),
p{i} AS (SELECT n.node, least(n.label, coalesce(j.label, n.label)) AS label FROM n{i} n LEFT JOIN n{i} j ON j.node = n.label)"""
        for i in range(1, rounds + 1)
    )
    return f"""be AS ({edges}), ba AS (SELECT DISTINCT lower(source) AS node, lower(target) AS other FROM be UNION SELECT lower(target), lower(source) FROM be),
p0 AS (SELECT DISTINCT node, node AS label FROM ba), {steps},
comp AS (SELECT lower(name) AS member, name, type, coalesce(label, lower(name)) AS component FROM nodes_v LEFT JOIN p{rounds} ON node = lower(name))"""


_COMP = _labels_sql("SELECT source, target FROM edges_v WHERE valid_until IS NULL")


@query(with_views(f"WITH {_COMP} SELECT member, component FROM comp", "edges_v", "nodes_v"))
def components(spark, sf_dir):
    return communities.memberships(views.nodes(spark, sf_dir), views.edges(spark, sf_dir)).select("member", "component")


#: Customers in chains of 40, every other one closed to a cycle, some with a loop; the rest stays alone.
_CHAINS = """SELECT 'Customer#' || c_custkey AS source, 'Customer#' || CASE WHEN c_custkey % 40 <> 0 THEN c_custkey + 1 ELSE c_custkey - 39 END AS target FROM customer
WHERE c_custkey > 0 AND c_custkey % 7 <> 3 AND (c_custkey % 40 <> 0 OR c_custkey % 80 = 0) UNION ALL SELECT 'Customer#' || c_custkey, 'CUSTOMER#' || c_custkey FROM customer WHERE c_custkey % 11 = 0"""


@query(with_views(f"WITH {_labels_sql(_CHAINS)}, every AS (SELECT lower(name) AS member FROM nodes_v UNION SELECT node FROM p10) SELECT member, coalesce(label, member) AS component FROM every LEFT JOIN p10 ON node = member", "nodes_v"))
def component_chains(spark, sf_dir):
    key, name = F.col("c_custkey"), lambda k, word="Customer#": F.concat(F.lit(word), k.cast("string"))
    customer = read_table(spark, sf_dir, "customer").select("c_custkey")
    chain = customer.where((key > 0) & (key % 7 != 3) & ((key % 40 != 0) | (key % 80 == 0))).select(name(key).alias("source"), name(F.when(key % 40 != 0, key + 1).otherwise(key - 39)).alias("target"))
    loops = customer.where(key % 11 == 0).select(name(key).alias("source"), name(key, "CUSTOMER#").alias("target"))
    edges = chain.union(loops).withColumn("valid_until", F.lit(None).cast("date"))
    return communities.memberships(views.nodes(spark, sf_dir), edges).select("member", "component")


@query(with_views(f"""WITH {_COMP}, size AS (SELECT component, count(*) AS entity_count FROM comp GROUP BY 1),
kinds AS (SELECT component, type, count(*) AS n FROM comp GROUP BY 1, 2), best AS (SELECT component, type AS label, row_number() OVER (PARTITION BY component ORDER BY n DESC, type) AS r FROM kinds),
x AS (SELECT component, count(*) AS edge_count FROM (SELECT DISTINCT least(lower(source), lower(target)) AS a, greatest(lower(source), lower(target)) AS b FROM be) JOIN comp ON a = member GROUP BY 1)
SELECT component, label, entity_count, coalesce(edge_count, 0) AS edge_count FROM size JOIN best USING (component) LEFT JOIN x USING (component) WHERE r = 1""", "edges_v", "nodes_v"))
def component_labels(spark, sf_dir):
    return communities.communities(views.nodes(spark, sf_dir), views.edges(spark, sf_dir)).select("component", "label", "entity_count", "edge_count")


@query(with_views(f"""WITH {_COMP}, size AS (SELECT component, count(*) AS n, min(member) AS f FROM comp GROUP BY 1),
num AS (SELECT component, row_number() OVER (ORDER BY n DESC, f, component) - 1 AS cluster_id FROM size) SELECT cluster_id, name AS entity_name FROM comp JOIN num USING (component)""", "edges_v", "nodes_v"))
def cluster_members(spark, sf_dir):
    return communities.cluster_table(views.nodes(spark, sf_dir), views.edges(spark, sf_dir)).select("cluster_id", "entity_name")


@query(with_views("WITH per AS (SELECT lower(canonical) AS c, list_sort(list(alias)) AS aliases FROM aliases_v GROUP BY 1) SELECT name, type, mention_count, first_seen, last_seen, confidence, coalesce(array_to_string(aliases, ','), '') AS aliases FROM nodes_v LEFT JOIN per ON c = lower(name)", "nodes_v", "aliases_v"))
def export_nodes(spark, sf_dir):
    return timeline.export_nodes(views.nodes(spark, sf_dir), views.aliases(spark, sf_dir)).withColumn("aliases", F.concat_ws(",", "aliases"))


@query(with_views("SELECT source, target, rel_type AS relation, round(1e-9 + CASE WHEN coalesce(weight, 0) = 0 THEN 0.5 ELSE weight END, 6) AS weight, evidence, event_time, valid_from, valid_until, last_reinforced FROM edges_v", "edges_v"))
def export_edges(spark, sf_dir):
    return timeline.export_edges(views.edges(spark, sf_dir)).withColumn("weight", F.round(F.col("weight") + 1e-9, 6))


@query(with_views("SELECT name, type, least(15 + 3 * mention_count, 60) AS size, CASE type WHEN 'PERSON' THEN '#4287f5' WHEN 'ORGANIZATION' THEN '#3498db' WHEN 'PLACE' THEN '#f1c40f' ELSE '#e74c3c' END AS color FROM nodes_v", "nodes_v"))
def drawn_nodes(spark, sf_dir):
    return timeline.drawn_nodes(views.nodes(spark, sf_dir)).withColumn("size", F.col("size").cast("long"))


# --- entity resolution --------------------------------------------------------------------------

_PAIR = "a.mention_count > b.mention_count OR (a.mention_count = b.mention_count AND a.name < b.name)"
_RATIO = "least(length(trim(a.name)), length(trim(b.name))) / greatest(length(trim(a.name)), length(trim(b.name)))"
_PCOS = "list_sum(list_transform(range(1, 27), lambda i: a.e[i] * b.e[i])) / (sqrt(list_sum(list_transform(a.e, lambda x: x * x))) * sqrt(list_sum(list_transform(b.e, lambda x: x * x))))"


def _names(spark, sf_dir):
    return views.names(spark, sf_dir)


@query(with_views(f"SELECT a.name AS source, b.name AS target, round({_RATIO}, 6) AS ratio FROM names_v a JOIN names_v b ON ({_PAIR}) AND {_RATIO} >= 0.6", "names_v"))
def name_length_band(spark, sf_dir):
    p = resolve.pair_blocks(_names(spark, sf_dir), 0.6)
    return p.select("source", "target", F.round(similarity.length_ratio(F.col("source"), F.col("target")), 6).alias("ratio"))


@query(with_views(f"SELECT a.name AS source, b.name AS target, round({_PCOS}, 6) AS vector_sim FROM names_v a JOIN names_v b ON ({_PAIR}) AND {_RATIO} >= 0.33 WHERE round({_PCOS}, 9) >= 0.9", "names_v"))
def cosine_pairs(spark, sf_dir):
    p = resolve.pair_blocks(_names(spark, sf_dir)).withColumn("vector_sim", similarity.unit_cosine(F.col("__va"), F.col("__vb")))
    return p.where("round(vector_sim, 9) >= 0.9").select("source", "target", F.round("vector_sim", 6).alias("vector_sim"))


@query()
def dedup_scan(spark, sf_dir):
    found = resolve.scan_all(_names(spark, sf_dir))
    return found.select("source", "target", F.round("vector_sim", 4).alias("vector_sim"), F.round("name_sim", 4).alias("name_sim"), "decision")


@query()
def jaro_winkler(spark, sf_dir):
    p = resolve.pair_blocks(_names(spark, sf_dir))
    return p.select("source", "target", F.round(similarity.jaro_winkler_udf("source", "target"), 6).alias("name_sim"))


@query(with_views("""WITH m AS (SELECT id, CASE WHEN lower(source) = 'nation_7' THEN 'NATION_8' ELSE source END AS source, CASE WHEN lower(target) = 'nation_7' THEN 'NATION_8' ELSE target END AS target, rel_type FROM edges_v)
SELECT source, target, rel_type FROM (SELECT *, row_number() OVER (PARTITION BY source, target, rel_type ORDER BY id) AS r FROM m WHERE lower(source) <> lower(target)) WHERE r = 1""", "edges_v"))
def merge_edges(spark, sf_dir):
    return resolve.merge_edges(views.edges(spark, sf_dir), "nation_7", "NATION_8").select("source", "target", "rel_type")


@query(with_views("SELECT name, type, mention_count + CASE WHEN name = 'NATION_8' THEN (SELECT mention_count FROM nodes_v WHERE name = 'NATION_7') ELSE 0 END AS mention_count FROM nodes_v WHERE name <> 'NATION_7'", "nodes_v"))
def merge_nodes(spark, sf_dir):
    return resolve.merge_nodes(views.nodes(spark, sf_dir), "nation_7", "NATION_8").select("name", "type", "mention_count")


# --- temporal graph -----------------------------------------------------------------------------


@query("SELECT CAST(user_id AS VARCHAR) AS name, arg_max(event_type, (ts, event_id)) AS type, count(*) AS mention_count, CAST(arg_min(ts, (ts, event_id)) AS DATE) AS first_seen, CAST(arg_max(ts, (ts, event_id)) AS DATE) AS last_seen, round(max(value / 1000), 6) AS confidence FROM events GROUP BY 1")
def upsert_nodes(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    log = e.select(F.col("user_id").cast("string").alias("name"), F.col("event_type").alias("type"), F.col("ts").cast("date").alias("date"), (F.col("value") / 1000).alias("confidence"), F.struct("ts", "event_id").alias("seq"))
    return history.fold_nodes(log).withColumn("confidence", F.round("confidence", 6))


@query(with_views("SELECT source, target, rel_type, round(weight + 1e-9, 6) AS weight, evidence, source_hash, event_time, valid_from, last_reinforced FROM folded_v", "folded_v"))
def upsert_edges_fold(spark, sf_dir):
    e = history.fold_edges(views.assertions(spark, sf_dir).withColumnRenamed("x", "weight"))
    return e.drop("assertions").withColumn("weight", F.round(F.col("weight") + 1e-9, 6))


@query(with_views("SELECT id, CASE WHEN lower(target) = 'nation_7' AND lower(rel_type) = 'lives_in' THEN DATE '1999-01-01' ELSE valid_until END AS valid_until FROM edges_v", "edges_v"))
def invalidate_edges(spark, sf_dir):
    changed, _ = history.invalidate_edges(views.edges(spark, sf_dir), AS_OF, target="nation_7", rel_type="lives_in")
    return changed.select("id", "valid_until")


@query(with_views("SELECT id, round(weight + 1e-9, 6) AS weight FROM edges_v WHERE valid_until IS NULL", "edges_v"))
def current_edges(spark, sf_dir):
    return history.current(views.edges(spark, sf_dir)).select("id", F.round(F.col("weight") + 1e-9, 6).alias("weight"))


_DECAY = "SELECT source, target, rel_type, round(weight + 1e-9, 6) AS old_weight, round(greatest(weight * pow(0.5, (DATE '1999-01-01' - last_reinforced) / 365.0), 0.1), 6) AS new_weight, CAST(DATE '1999-01-01' - last_reinforced AS INTEGER) AS days_since_reinforced, last_reinforced FROM edges_v WHERE valid_until IS NULL AND last_reinforced < DATE '1999-01-01' AND greatest(weight * pow(0.5, (DATE '1999-01-01' - last_reinforced) / 365.0), 0.1) <> weight"


@query(with_views(_DECAY, "edges_v"))
def confidence_decay(spark, sf_dir):
    return history.decay(views.edges(spark, sf_dir), AS_OF, 365)


@query(with_views(f"WITH {_COMP}, changed AS ({_DECAY}) SELECT (SELECT count(*) FROM changed) AS edges_decayed, (SELECT count(*) FROM (SELECT id FROM memories_v WHERE date <= DATE '2025-01-15' - 30 ORDER BY date DESC, id DESC LIMIT 50)) AS stale_count, (SELECT count(DISTINCT component) FROM comp) AS cluster_count, (SELECT count(*) FROM comp) AS total_entities", "memories_v", "edges_v", "nodes_v"))
def consolidate_report(spark, sf_dir):
    decayed = history.decay(views.edges(spark, sf_dir), AS_OF, 365).agg(F.count("*").alias("edges_decayed"))
    old = timeline.stale(_memories(spark, sf_dir), MEMORY_DAY).agg(F.count("*").alias("stale_count"))
    found = communities.communities(views.nodes(spark, sf_dir), views.edges(spark, sf_dir))
    groups = found.agg(F.count("*").alias("cluster_count"), F.sum("entity_count").alias("total_entities"))
    return decayed.join(old, F.lit(True)).join(groups, F.lit(True))  # three single rows


# --- streaming extensions -----------------------------------------------------------------------


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS id FROM documents GROUP BY 1")
def stream_dedup_save(spark, sf_dir):
    return extensions.drain_saves(spark, f"{sf_dir}/documents.parquet").select("content_hash", "id")


@query("SELECT CAST(user_id AS VARCHAR) AS name, count(*) AS mention_count, CAST(max(ts) AS DATE) AS last_seen FROM events GROUP BY 1")
def stream_upsert_nodes(spark, sf_dir):
    return extensions.drain_mentions(spark, f"{sf_dir}/events.parquet").select("name", "mention_count", "last_seen")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
