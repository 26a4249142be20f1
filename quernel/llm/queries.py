"""The queries of the ``llm`` operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import decontam, hilbert, html_density, lm_score, matroska, packing, quality, repair, simhash, toxicity
from quernel.workspace import read_table, stage


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_score.backoff_scores(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"), "n_longest", "n_first", "n_unknown")


#: Words: runs of other than ASCII white space, A-Z lower-cased. Trigrams, bigrams, words, then unknown.
OP1_SQL = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS ws
  FROM documents
), place AS (
  SELECT r, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v, CASE WHEN i > 2 THEN ws[i - 2] END AS u
  FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM docs)
), o1 AS (SELECT r, w, count(*) AS c FROM place GROUP BY r, w
), o2 AS (SELECT r, v, w, count(*) AS c FROM place WHERE v IS NOT NULL GROUP BY r, v, w
), o3 AS (SELECT r, u, v, w, count(*) AS c FROM place WHERE u IS NOT NULL GROUP BY r, u, v, w
), e1 AS (SELECT r, w, sum(c) OVER (PARTITION BY w) - c AS e FROM o1
), e2 AS (SELECT r, v, w, sum(c) OVER (PARTITION BY v, w) - c AS e FROM o2
), e3 AS (SELECT r, u, v, w, sum(c) OVER (PARTITION BY u, v, w) - c AS e FROM o3
), n AS (SELECT count(*) AS words FROM place
), s AS (
  SELECT p.r, least(p.i, 3) AS depth, a.e AS one, coalesce(b.e, 0) AS two, coalesce(c.e, 0) AS three, k1.e AS before_two, k2.e AS before_three, greatest(1, n.words - len(d.ws)) AS rest
  FROM place p JOIN docs d USING (r) CROSS JOIN n JOIN e1 a ON a.r = p.r AND a.w = p.w
  LEFT JOIN e2 b ON b.r = p.r AND b.v = p.v AND b.w = p.w LEFT JOIN e3 c ON c.r = p.r AND c.u = p.u AND c.v = p.v AND c.w = p.w
  LEFT JOIN e1 k1 ON k1.r = p.r AND k1.w = p.v LEFT JOIN e2 k2 ON k2.r = p.r AND k2.v = p.u AND k2.w = p.v
), t AS (
  SELECT r, CASE WHEN three > 0 THEN 3 WHEN two > 0 THEN 2 WHEN one > 0 THEN 1 ELSE 0 END AS hit,
    CASE WHEN three > 0 THEN ln(three / before_three) WHEN two > 0 THEN ln(two / before_two) + (depth - 2) * ln(0.4)
         WHEN one > 0 THEN ln(one / rest) + (depth - 1) * ln(0.4) ELSE 3 * ln(0.4) - ln(rest) END AS l
  FROM s
), a AS (
  SELECT r, sum(l) AS l, count(*) FILTER (hit = 3) AS n3, count(*) FILTER (hit = 1) AS n1, count(*) FILTER (hit = 0) AS n0 FROM t GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(l, 0), 4) AS log_score,
  round(CASE WHEN len(ws) > 0 THEN l / len(ws) ELSE 0 END, 6) AS mean_log_score,
  coalesce(n3, 0) AS n_longest, coalesce(n1, 0) AS n_first, coalesce(n0, 0) AS n_unknown
FROM docs LEFT JOIN a USING (r)
"""


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digests(stage(matroska.store_texts(read_table(spark, sf_dir, "documents")), "media"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op4_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return repair.token_ids(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.main_text(read_table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.fingerprint_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert.document_shards(read_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def queries() -> dict:
    return {f.__name__: f for f in (op1_lm_score, op2_matroska, op3_best_fit_packing, op4_repair_tokens, op5_html_density, op6_decontamination, op7_toxicity, op8_quality, op9_simhash_near_dedup, op10_hilbert_shards)}


def oracle_sql() -> dict:
    return {"op1_lm_score": OP1_SQL}
