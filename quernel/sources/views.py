"""The retrieval data model over the driver's tables: memories, vectors, and a temporal graph.

Each view is a DataFrame and, for checks, a text of DuckDB SQL (``SQL``) that defines it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.workspace import kept, read_table, staged_path

DAY0 = "2024-01-01"
ORDER_KEY = ["o_orderdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "x", "l_tax", "l_shipdate"]


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories, one per content hash (the smallest id wins); a table of the store, filled once."""
    return kept(spark, f"{sf_dir}/memories", lambda: _memories(spark, sf_dir))


def _memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only hashes and ids are grouped; texts are read again, without those that came later."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").withColumn("content_hash", F.sha2("text", 256))
    day = F.date_add(F.lit(DAY0).cast("date"), (F.col("doc_id") % 365).cast("int"))
    repeated = docs.groupBy("content_hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = docs.select("content_hash", "doc_id").join(repeated, "content_hash").where("doc_id <> first").select("doc_id")
    return docs.join(later, "doc_id", "left_anti").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("content"),
        day.alias("date"),
        F.col("lang").alias("mood"),
        day.cast("timestamp").alias("ts"),
        "content_hash",
        F.array("source").alias("tags"),
        F.when(F.col("doc_id") % 3 == 0, F.date_sub(day, 30)).alias("event_time"),
    )


def text_index(spark: SparkSession, sf_dir: str) -> str:
    """Where the stored full-text index of the memories is; built with the first search of an application."""
    from quernel.operators.text_search import write_index

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        path = staged_path(spark, "text-index")
        write_index(memories(spark, sf_dir), path)
        _INDEXES[key] = path
    return _INDEXES[key]


_INDEXES: dict[tuple[str, str], str] = {}


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read_table(spark, sf_dir, "embeddings")
    return raw.select("vec_id", F.sha2(F.col("vec_id").cast("string"), 256).alias("content_hash"), F.col("embedding").cast("array<double>").alias("embedding"))


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who bought from whom, once per order line: x = 1 - discount, in the order of the order key."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    lines = read_table(spark, sf_dir, "lineitem").withColumn("x", 1 - F.col("l_discount"))
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.select(
        F.concat(F.lit("Customer#"), "o_custkey").alias("source"),
        F.concat(F.lit("Supplier#"), "l_suppkey").alias("target"),
        F.lit("BOUGHT_FROM").alias("rel_type"),
        F.struct(*ORDER_KEY).alias("seq"),
        "x",
        F.concat(F.lit("line "), "l_linenumber").alias("evidence"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("source_hash"),
        F.col("o_orderdate").cast("date").alias("event_time"),
        "o_orderstatus",
    )


def static_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where customers live, where suppliers are, which region a nation is part of; weight 0.5."""
    customer, supplier = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "supplier")
    nation, region = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    lives = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(F.concat(F.lit("Customer#"), "c_custkey").alias("source"), F.col("n_name").alias("target"), F.lit("LIVES_IN").alias("rel_type"))
    located = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(F.concat(F.lit("Supplier#"), "s_suppkey").alias("source"), F.col("n_name").alias("target"), F.lit("LOCATED_IN").alias("rel_type"))
    part = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_name").alias("source"), F.col("r_name").alias("target"), F.lit("PART_OF").alias("rel_type"))
    both = lives.unionByName(located).unionByName(part)
    return both.select("source", "target", "rel_type", F.lit(0.5).alias("weight"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static edges and the folded purchases, with validity; a table of the store, filled once. ``id`` is the edge's own key."""
    return kept(spark, f"{sf_dir}/edges", lambda: _edges(spark, sf_dir))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.operators.temporal import fold_edges

    bought = fold_edges(assertions(spark, sf_dir).withColumnRenamed("x", "weight"), extra={"status": F.max_by("o_orderstatus", "seq")})
    until = F.when(F.col("status") == "F", F.date_add("last_reinforced", 90))
    # Rounded, so that the order of additions doesn't decide between equal weights.
    bought = bought.select("source", "target", "rel_type", F.round(F.col("weight") + 1e-12, 9).alias("weight"), "evidence", "source_hash", "event_time", "valid_from", until.alias("valid_until"), "last_reinforced")
    fixed = static_edges(spark, sf_dir).select(
        "source", "target", "rel_type", "weight", F.concat_ws(" ", "source", "rel_type", "target").alias("evidence"), F.sha2(F.concat("source", "target"), 256).alias("source_hash"),
        F.lit(None).cast("date").alias("event_time"), F.lit(DAY0).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_until"), F.lit(None).cast("date").alias("last_reinforced"),
    )
    return bought.unionByName(fixed).withColumn("id", F.concat_ws("|", "source", "target", "rel_type"))


def place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The static part of ``edges`` with ids: a small graph with hubs (nations)."""
    e = static_edges(spark, sf_dir)
    return e.select(F.concat_ws("|", "source", "target", "rel_type").alias("id"), "*", F.sha2(F.concat("source", "target"), 256).alias("source_hash"), F.concat_ws(" ", "source", "rel_type", "target").alias("evidence"), F.lit(None).cast("date").alias("valid_until"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names of the graph; mentions = edges asserted from or to them in the static part, plus orders."""
    customer, supplier = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "supplier")
    nation, region = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    orders = read_table(spark, sf_dir, "orders")
    bought = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    people = customer.join(bought, customer.c_custkey == bought.o_custkey, "left")
    none = F.lit(None).cast("date")
    parts = [
        people.select(F.col("c_custkey").alias("k"), F.concat(F.lit("Customer#"), "c_custkey").alias("name"), F.lit("PERSON").alias("type"), F.coalesce("n", F.lit(0)).alias("mention_count"), F.col("a").alias("first_seen"), F.col("b").alias("last_seen"), (0.5 + F.col("c_custkey") % 50 / 100).alias("confidence")),
        supplier.select(F.col("s_suppkey"), F.concat(F.lit("Supplier#"), "s_suppkey"), F.lit("ORGANIZATION"), (F.col("s_suppkey") % 7).alias("m"), none, none, F.lit(1.0)),
        nation.join(customer.groupBy("c_nationkey").agg(F.count("*").alias("n")), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("n_nationkey").cast("long"), "n_name", F.lit("PLACE"), F.coalesce("n", F.lit(0)), none, none, F.lit(1.0)),
        region.select(F.col("r_regionkey").cast("long"), "r_name", F.lit("REGION"), F.lit(5), none, none, F.lit(1.0)),
    ]
    out = parts[0]
    for i, p in enumerate(parts[1:], 1):
        out = out.union(p)
    kind = F.when(F.col("type") == "PERSON", 0).when(F.col("type") == "ORGANIZATION", 1).when(F.col("type") == "PLACE", 2).otherwise(3)
    return out.select((kind.cast("long") * 1_000_000_000_000 + F.col("k")).alias("id"), "name", "type", F.col("mention_count").cast("long").alias("mention_count"), "first_seen", "last_seen", "confidence")


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region names stand for their nations' lower-case names; every 10th customer has a short name."""
    nation, region = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    a = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.lower("n_name").alias("alias"), F.col("r_name").alias("canonical"))
    b = read_table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("alias"), F.concat(F.lit("Customer#"), "c_custkey").alias("canonical"))
    return a.union(b)


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names of parts with their brands, how many parts bear them, and a vector of their letters' counts."""
    named = read_table(spark, sf_dir, "part").groupBy(F.concat_ws(" ", "p_name", "p_brand").alias("name")).agg(F.count("*").alias("mention_count"))
    low, letters = F.lower("name"), F.split(F.lit("a b c d e f g h i j k l m n o p q r s t u v w x y z"), " ")
    return named.withColumn("embedding", F.transform(letters, lambda x: (F.length(low) - F.length(F.replace(low, x, F.lit("")))).cast("double")))


#: The same views as DuckDB SQL, by name; each may name earlier ones.
SQL = {
    "memories_v": f"""SELECT id, content, date, mood, content_hash, tags, event_time FROM (
  SELECT doc_id AS id, text AS content, DATE '{DAY0}' + CAST(doc_id % 365 AS INTEGER) AS date, lang AS mood, sha256(text) AS content_hash, [source] AS tags,
    CASE WHEN doc_id % 3 = 0 THEN DATE '{DAY0}' + CAST(doc_id % 365 AS INTEGER) - 30 END AS event_time,
    row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
    "vectors_v": "SELECT vec_id, sha256(CAST(vec_id AS VARCHAR)) AS content_hash, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings",
    "assertions_v": """SELECT 'Customer#' || o_custkey AS source, 'Supplier#' || l_suppkey AS target, 'BOUGHT_FROM' AS rel_type, 1 - l_discount AS x,
  (o_orderdate, l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice, 1 - l_discount, l_tax, l_shipdate) AS seq,
  'line ' || l_linenumber AS evidence, sha256(CAST(o_orderkey AS VARCHAR)) AS source_hash, CAST(o_orderdate AS DATE) AS event_time, o_orderstatus
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "folded_v": """SELECT source, target, rel_type,
    sum(CASE WHEN rn = 1 THEN x * pow(0.5, n - 1) ELSE x * pow(0.5, n - rn + 1) END) AS weight,
    max(CASE WHEN rn = n THEN evidence END) AS evidence, max(CASE WHEN rn = n THEN source_hash END) AS source_hash, max(CASE WHEN rn = n THEN event_time END) AS event_time,
    min(CASE WHEN rn = 1 THEN event_time END) AS valid_from, max(CASE WHEN rn = n THEN event_time END) AS last_reinforced, max(CASE WHEN rn = n THEN o_orderstatus END) AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY source, target, rel_type ORDER BY seq) AS rn, count(*) OVER (PARTITION BY source, target, rel_type) AS n FROM assertions_v) GROUP BY ALL""",
    "static_v": """SELECT 'Customer#' || c_custkey AS source, n_name AS target, 'LIVES_IN' AS rel_type, CAST(0.5 AS DOUBLE) AS weight FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'Supplier#' || s_suppkey, n_name, 'LOCATED_IN', 0.5 FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT n_name, r_name, 'PART_OF', 0.5 FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "edges_v": f"""SELECT *, source || '|' || target || '|' || rel_type AS id FROM (
  SELECT source, target, rel_type, round(weight + 1e-12, 9) AS weight, evidence, source_hash, event_time, valid_from, CASE WHEN status = 'F' THEN last_reinforced + 90 END AS valid_until, last_reinforced FROM folded_v
  UNION ALL SELECT source, target, rel_type, weight, source || ' ' || rel_type || ' ' || target, sha256(source || target), NULL, DATE '{DAY0}', NULL, NULL FROM static_v)""",
    "places_v": "SELECT source || '|' || target || '|' || rel_type AS id, *, sha256(source || target) AS source_hash, source || ' ' || rel_type || ' ' || target AS evidence FROM static_v",
    "nodes_v": """SELECT 0 * 1000000000000 + c_custkey AS id, 'Customer#' || c_custkey AS name, 'PERSON' AS type, coalesce(n, 0) AS mention_count, a AS first_seen, b AS last_seen, 0.5 + CAST(c_custkey % 50 AS DOUBLE) / 100 AS confidence
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1) ON c_custkey = o_custkey
  UNION ALL SELECT 1 * 1000000000000 + s_suppkey, 'Supplier#' || s_suppkey, 'ORGANIZATION', s_suppkey % 7, NULL, NULL, 1.0 FROM supplier
  UNION ALL SELECT 2 * 1000000000000 + n_nationkey, n_name, 'PLACE', coalesce(n, 0), NULL, NULL, 1.0 FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey
  UNION ALL SELECT 3 * 1000000000000 + r_regionkey, r_name, 'REGION', 5, NULL, NULL, 1.0 FROM region""",
    "aliases_v": """SELECT lower(n_name) AS alias, r_name AS canonical FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'c' || c_custkey, 'Customer#' || c_custkey FROM customer WHERE c_custkey % 10 = 0""",
    "names_v": """SELECT *, list_transform(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' '), lambda x: CAST(length(name) - length(replace(lower(name), x, '')) AS DOUBLE)) AS e
  FROM (SELECT p_name || ' ' || p_brand AS name, count(*) AS mention_count FROM part GROUP BY 1)""",
}
_NEEDS = {"folded_v": ["assertions_v"], "edges_v": ["assertions_v", "folded_v", "static_v"], "places_v": ["static_v"]}


def with_views(body: str, *wanted: str, recursive: bool = False) -> str:
    """``body`` with the named views, and what they need, before it as common table expressions."""
    order = [v for v in SQL if v in wanted or any(v in _NEEDS.get(w, ()) for w in wanted)]
    ctes = ",\n".join(f"{v} AS ({SQL[v]})" for v in order)
    body = body.strip()
    rest = body[4:] if body[:5].upper() == "WITH " else None
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}" + (f",\n{rest.strip()}" if rest is not None else f"\n{body}")
