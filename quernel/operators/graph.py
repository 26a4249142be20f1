"""Graph reads: lookups by name, degree, aliases, k hops, bounded traversal, shortest paths.

Names are matched with A-Z folded (``nocase``). Edges are undirected; to avoid joins on "source or
target" they are laid out once per end (``adjacency``).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.text import nocase, whole_word
from quernel.operators.temporal import current
from quernel.workspace import stage

HUB_DEGREE, FAN_OUT = 15, 50


def adjacency(edges: DataFrame, fold=nocase) -> DataFrame:
    """``edges`` once for each end: ``node`` (folded), ``other`` (folded), ``is_target``; a loop once."""
    out = edges.withColumns({"node": fold("source"), "other": fold("target"), "is_target": F.lit(0)})
    back = edges.withColumns({"node": fold("target"), "other": fold("source"), "is_target": F.lit(1)})
    return out.unionByName(back.where(F.col("node") != F.col("other")))


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, degree)`` over all edges, also invalid ones; a loop counts once."""
    return edges.select(F.explode(F.array_distinct(F.array(nocase("source"), nocase("target")))).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def degree(edges: DataFrame, name: str) -> int:
    n = nocase(F.lit(name))
    return edges.where((nocase("source") == n) | (nocase("target") == n)).count()


def top_entity(nodes: DataFrame) -> DataFrame:
    """The most mentioned node (the smallest id on ties)."""
    return nodes.orderBy(F.desc("mention_count"), "id").limit(1)


def search_nodes(nodes: DataFrame, query: str, limit: int = 30, min_confidence: float = 0.0) -> DataFrame:
    """Nodes whose name contains the query (% and _ are wildcards), cut by mentions, then by how well they match.

    ``match``: 0 equal, 1 begins with the query as a word (or, for several words, ends so), 2 holds
    it as a word, 3 as a part. The cut comes first, so a rare exact match can be lost.
    """
    q = query.lower()
    found = nodes.where(F.like(nocase("name"), F.concat(F.lit("%"), nocase(F.lit(query)), F.lit("%"))))
    if min_confidence > 0:
        found = found.where(F.coalesce("confidence", F.lit(1.0)) >= min_confidence)
    cut = found.orderBy(F.desc("mention_count"), "id").limit(limit)
    name = F.lower("name")
    ends = F.lit(False) if " " not in q else name.endswith(" " + q)
    match = F.when(name == q, 0).when(name.startswith(q + " ") | ends, 1).when(whole_word(F.col("name"), query), 2).otherwise(3)
    return cut.withColumn("match", match).orderBy("match", F.desc("mention_count"), "id")


def search_words(nodes: DataFrame, words: list[str], limit: int) -> DataFrame:
    """For each word the nodes that ``search_nodes`` cuts to ``limit``, if they hold it as a whole word; one pass.

    Columns of the nodes, ``word_no`` and ``match``; by word, then as ``search_nodes`` orders them.
    """
    spark = nodes.sparkSession
    if not words:
        return nodes.withColumns({"word_no": F.lit(0), "match": F.lit(0)}).limit(0)
    asked = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "word_no int, word string")
    like = F.like(nocase("name"), F.concat(F.lit("%"), nocase("word"), F.lit("%")))
    met = nodes.join(F.broadcast(asked), like)  # the words of one query
    w = Window.partitionBy("word_no").orderBy(F.desc("mention_count"), "id")
    cut = met.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")
    q, name = F.lower("word"), F.lower("name")
    whole = reduce(Column.__or__, [(F.col("word_no") == i) & whole_word(F.col("name"), x) for i, x in enumerate(words)])
    ends = F.contains(q, F.lit(" ")) & F.endswith(name, F.concat(F.lit(" "), q))
    match = F.when(name == q, 0).when(F.startswith(name, F.concat(q, F.lit(" "))) | ends, 1).otherwise(2)
    return cut.where(whole).withColumn("match", match).orderBy("word_no", "match", F.desc("mention_count"), "id").drop("word")


def resolve_names(aliases: DataFrame, names: DataFrame) -> DataFrame:
    """``names(name)`` -> ``(name, resolved, step)``: itself (0), its canonical names (1), their and its aliases (2).

    One step up, one step down, not transitive; each folded spelling once, the nearest step first.
    """
    up = names.join(aliases, nocase("name") == nocase("alias")).select("name", F.col("canonical").alias("resolved"), F.lit(1).alias("step"))
    roots = names.select("name", F.col("name").alias("resolved"), F.lit(0).alias("step")).unionByName(up)
    down = roots.join(aliases, nocase("resolved") == nocase("canonical")).select("name", F.col("alias").alias("resolved"), F.lit(2).alias("step"))
    w = Window.partitionBy("name", F.lower("resolved")).orderBy("step", "resolved")
    return roots.unionByName(down).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def enrich(nodes: DataFrame, names: DataFrame, key: str = "name") -> DataFrame:
    """Type, mentions, dates and confidence of names; names without a node keep defaults."""
    n = nodes.select(nocase("name").alias("__k"), *[F.col(c).alias(f"__{c}") for c in ("name", "type", "mention_count", "first_seen", "last_seen", "confidence")])
    w = Window.partitionBy("__k").orderBy("__name")
    n = n.withColumn("__r", F.row_number().over(w)).where("__r = 1")
    wide = names.join(n, nocase(key) == F.col("__k"), "left")
    return wide.select(*names.columns, F.coalesce("__type", F.lit("")).alias("type"), F.coalesce("__mention_count", F.lit(0)).alias("mention_count"), F.col("__first_seen").alias("first_seen"), F.col("__last_seen").alias("last_seen"), F.coalesce("__confidence", F.lit(1.0)).alias("confidence"))


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """``seeds(node)`` (folded) -> ``(node, depth)`` of all that is within ``hops`` of any seed.

    The frontier only ever holds new nodes; beyond two hops each one is a written table.
    """
    adj = adjacency(edges).select("node", "other").distinct()
    seen = frontier = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    for depth in range(1, hops + 1):
        step = frontier.join(adj, "node").select(F.col("other").alias("node")).distinct()
        frontier = step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth))
        frontier = stage(frontier, "frontier") if hops > 2 else frontier
        seen = seen.unionByName(frontier)
    return seen


@dataclass
class Traversal:
    """Small by construction: at most a few edges over the limit, and the nodes on them."""

    edges: list = field(default_factory=list)
    nodes: dict[str, str] = field(default_factory=dict)  #: folded name -> spelling seen last


def _incident(edges: DataFrame, names: list[str], include_historical: bool, keep: int = FAN_OUT) -> dict[str, list]:
    """The ``keep`` heaviest edges of each name (folded); bounded by names x keep rows."""
    wanted = sorted({n.translate(_ASCII) for n in names})
    rows = adjacency(current(edges, include_historical)).where(F.col("node").isin(wanted))
    order = [F.desc("weight"), *(["is_target"] if include_historical else []), "id"]
    w = Window.partitionBy("node").orderBy(*order)
    out: dict[str, list] = {}
    for r in rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= keep).orderBy("node", "__n").collect():
        out.setdefault(r.node, []).append(r)
    return out


_ASCII = {ord(a): ord(a) + 32 for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def traverse(edges: DataFrame, aliases: DataFrame, entity: str, max_hops: int = 2, limit: int = 20, include_historical: bool = False) -> Traversal:
    """Breadth first from an entity and its aliases, with the caps that define its result.

    A hub (degree over 15, historical edges included) goes one hop. At most 50 edges a node, by
    weight. Nodes are taken up while fewer than ``limit`` edges are there; then edges, but not
    nodes, are cut to ``limit``. Edges seen from one alias don't lead on from another. Each level is
    one query for the neighbours of the nodes that can still be taken up, so the driver holds at
    most ``limit`` x 50 rows.
    """
    spark = edges.sparkSession
    asked = spark.createDataFrame([(entity,)], "name string")
    starts = [r.resolved for r in resolve_names(aliases, asked).orderBy("step", "resolved").collect()]
    hops = 1 if degree(edges, entity) > HUB_DEGREE else max_hops
    out, seen = Traversal(), set()
    for start in starts:
        level, visited = [start], {start.lower()}
        for _ in range(hops):
            following: list[str] = []
            for at in range(0, len(level), limit):
                if len(out.edges) >= limit:
                    break
                part = level[at : at + limit]
                near = _incident(edges, part, include_historical)
                for name in part:
                    if len(out.edges) >= limit:
                        break
                    for e in near.get(name.translate(_ASCII), []):
                        mark = (e.source.lower(), e.target.lower(), e.rel_type, e.source_hash)
                        if mark in seen:
                            continue
                        seen.add(mark)
                        out.edges.append(e)
                        out.nodes[e.source.lower()], out.nodes[e.target.lower()] = e.source, e.target
                        other = e.target if e.source.lower() == name.lower() else e.source
                        if other.lower() not in visited:
                            visited.add(other.lower())
                            following.append(other)
            level = following
    out.edges = out.edges[:limit]
    return out


def shortest_path_lengths(edges: DataFrame, source: str, max_hops: int | None = None, include_historical: bool = False) -> DataFrame:
    """``(node, depth)`` of everything that can be reached (within ``max_hops``, if given) from a name, in full lower case."""
    lower = edges if include_historical else current(edges)
    adj = adjacency(lower, F.lower).select("node", "other").distinct()
    seen = frontier = edges.sparkSession.createDataFrame([(source.lower(), 0)], "node string, depth int")
    for depth in count(1) if max_hops is None else range(1, max_hops + 1):
        step = frontier.join(adj, "node").select(F.col("other").alias("node")).distinct()
        frontier = stage(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def find_path(edges: DataFrame, source: str, target: str, include_historical: bool = False) -> list[str]:
    """Names on a shortest path, ends included; [] if there is none. A name is a path to itself.

    Each node remembers the parent that reaches it first: by the parent's own order, then the edge's
    id. Levels are tables, and there is no bound on their number: the search ends with the target
    or an empty level. Only the path comes to the driver.
    """
    if source.lower() == target.lower():
        return [source]
    adj = adjacency(current(edges, include_historical), F.lower).withColumn("spelling", F.when(F.col("is_target") == 0, F.col("target")).otherwise(F.col("source"))).select("node", "other", "spelling", "id")
    spark = edges.sparkSession
    seen = frontier = spark.createDataFrame([(source.lower(), None, source, "")], "node string, parent string, spelling string, place string")
    levels: list[DataFrame] = []
    while True:
        way = F.concat_ws("\x00", "f.place", "adj.id")
        step = frontier.alias("f").join(adj.alias("adj"), "node").select(F.col("adj.other").alias("node"), F.col("node").alias("parent"), F.col("adj.spelling").alias("spelling"), way.alias("place"))
        first = step.groupBy("node").agg(F.min_by(F.struct("parent", "spelling", "place"), "place").alias("b")).select("node", "b.*")
        frontier = stage(first.join(seen, "node", "left_anti"), "path-level")
        levels.append(frontier)
        if frontier.isEmpty():
            return []
        seen = seen.unionByName(frontier)
        hit = frontier.where(F.col("node") == target.lower()).first()
        if hit:
            path = [hit.spelling]
            for level in reversed(levels[:-1]):
                hit = level.where(F.col("node") == hit.parent).first()
                path.append(hit.spelling)
            return [source, *reversed(path)]


def evidence_hits(edges: DataFrame, score: Column) -> DataFrame:
    """Edges as results of the graph leg: evidence for content, the source hash for key."""
    none = lambda t: F.lit(None).cast(t)
    return edges.select(F.coalesce("evidence", F.lit("")).alias("content"), none("date").alias("date"), F.lit("").alias("mood"), none("timestamp").alias("ts"), score.alias("score"), F.lit("graph").alias("source"), F.coalesce("source_hash", F.lit("")).alias("content_hash"), none("date").alias("event_time"))
