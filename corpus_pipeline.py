"""From raw documents to packed training sequences, in five stages.

Every stage is a function of (spark, docs, sf_dir) and works on all rows of ``docs``; what it
decides takes effect. All but the last return the columns they were given. Each result is written
as Parquet and read again before the next stage, so a lost executor costs a part of one stage.

Null texts count as empty. Rows that repeat an id are judged each by its own text; of rows that repeat
id and text, the near-duplicate stage keeps one. Extra columns, whatever their names, are carried
along. Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernel.llm import decontam, packing, quality, simhash, toxicity
from quernel.workspace import read_table, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score is 0.5 or more."""
    return toxicity.without_toxic(docs, toxicity.fit_model(docs, read_table(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose quality score is under 0.5."""
    return quality.without_poor(docs, quality.fit_model(docs, read_table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the row with the smallest id."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item, with up to a fifth of its words edited."""
    return decontam.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2048 words without two documents of one source or cluster; a row per piece."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("simhash", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: No SQL: learned models, XXH64 fingerprints and greedy packing. tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
