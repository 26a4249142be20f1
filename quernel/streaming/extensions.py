"""Structured Streaming forms of the write path (extensions: saves and mentions as streams).

Both drain what is there (``availableNow``) into tables in the shared folder and can be left
running with any other trigger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.workspace import staged_path


def _source(spark: SparkSession, path: str):
    """A folder of Parquet files, or one file by its name in its folder."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    return reader.parquet(folder) if spark.read.parquet(path).inputFiles()[0].rstrip("/").endswith(name) else spark.readStream.schema(schema).parquet(path)


def saves(stream: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stream of saved texts -> the first save of each content hash; the state is a row per hash.

    With an event-time column use ``withWatermark`` and ``dropDuplicatesWithinWatermark`` instead, so
    that old hashes leave the state.
    """
    return stream.groupBy(F.sha2(text_col, 256).alias("content_hash")).agg(F.min(id_col).alias("id"))


def mentions(stream: DataFrame) -> DataFrame:
    """A stream of events -> running node state: mentions and the last day seen."""
    return stream.groupBy(F.col("user_id").cast("string").alias("name")).agg(F.count("*").alias("mention_count"), F.max("ts").cast("date").alias("last_seen"))


def _drain(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    out = staged_path(spark, label)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/state")  # complete mode: each batch holds all rows

    run = df.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{out}/state")


def drain_saves(spark: SparkSession, path: str) -> DataFrame:
    return _drain(spark, saves(_source(spark, path)), "stream-saves")


def drain_mentions(spark: SparkSession, path: str) -> DataFrame:
    return _drain(spark, mentions(_source(spark, path)), "stream-mentions")
