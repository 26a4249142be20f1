"""Tables as snapshots in a folder of any store that Spark reads, and the plain-text log of saves.

A write adds folders: a whole table, or rows that are appended to one. What counts is the newest
manifest, a small file that names the folders of every table; it is published last, so changes to
several tables are seen together or not at all. Nothing is updated in place.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.schema import ENTITY_INPUT, RELATION_INPUT, TABLES


MOST_PARTS = 64


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _manifests(self) -> list[str]:
        return [n for n in self._names("manifests") if n.endswith(".json") and not n.startswith((".", "_"))]

    def _state(self, manifest: str | None = None) -> dict[str, list[str]]:
        """The folders that make up each table, as the newest manifest says."""
        manifest = manifest or (self._manifests() or [None])[-1]
        if manifest is None:  # a store from before there were manifests: the newest complete snapshots
            done = {t: [n for n in self._names(t) if n[:1] == "v" and n[1:].isdigit() and "_SUCCESS" in self._names(f"{t}/{n}")] for t in TABLES}
            return {t: [f"{t}/{max(v, key=lambda n: int(n[1:]))}"] for t, v in done.items() if v}
        fs, path = self._at(f"manifests/{manifest}")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, table: str) -> DataFrame:
        """The table as last published; columns that its files don't have yet are null."""
        schema = self.spark.createDataFrame([], TABLES[table])
        folders = self._state().get(table)
        if not folders:
            return schema
        found = self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{f}" for f in folders])
        return schema.unionByName(found, allowMissingColumns=True).select(schema.columns)

    def commit(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None) -> None:
        """Writes tables and parts of tables, then publishes all of them with one manifest.

        A failure before that leaves everything as it was. Two writers can't publish the same
        number: the second one fails. A table of ``MOST_PARTS`` parts is written anew.
        """
        state, last = self._state(), (self._manifests() or ["0"])[-1].split(".")[0]
        for table, rows in (replace or {}).items():
            state[table] = [self._write(table, rows)]
        for table, rows in (append or {}).items():
            parts = state.get(table, [])
            state[table] = [*parts, self._write(table, rows)] if len(parts) < MOST_PARTS else [self._write(table, self.read(table).unionByName(rows, allowMissingColumns=True))]
        number = f"{int(last) + 1:012d}"
        fs, made = self._at(f"manifests/.{number}-{uuid.uuid4().hex}")
        out = fs.create(made)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        final = self._at(f"manifests/{number}.json")[1]
        if fs.exists(final) or not fs.rename(made, final):
            raise RuntimeError(f"another writer has published {number}; read again and repeat the call")

    def _write(self, table: str, rows: DataFrame) -> str:
        want = self.spark.createDataFrame([], TABLES[table]).schema
        folder = f"{table}/{uuid.uuid4().hex}"
        rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.fields]).write.parquet(f"{self.path}/{folder}")
        return folder

    def write(self, table: str, rows: DataFrame) -> None:
        self.commit({table: rows})

    def append(self, table: str, rows: DataFrame) -> None:
        self.commit(append={table: rows})

    def tables(self) -> dict[str, DataFrame]:
        return {t: self.read(t) for t in TABLES}

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the newest manifests, and the folders that none of these names."""
        manifests = self._manifests()
        if not manifests:
            return
        used = {f for m in manifests[-keep:] for folders in self._state(m).values() for f in folders}
        gone = [f"manifests/{m}" for m in manifests[:-keep]] + [f"{t}/{n}" for t in TABLES for n in self._names(t) if f"{t}/{n}" not in used]
        for name in gone:
            fs, path = self._at(name)
            fs.delete(path, True)

    def log(self, memories: DataFrame) -> None:
        """Appends saves as text blocks, a folder per day; repeats of a text are kept here."""
        head = F.concat(F.lit('---\ntime: "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('"\n'))
        mood = F.when(F.coalesce("mood", F.lit("")) != "", F.concat(F.lit('mood: "'), "mood", F.lit('"\n'))).otherwise("")
        tags = F.when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0, F.concat(F.lit("tags: ["), F.concat_ws(", ", "tags"), F.lit("]\n"))).otherwise("")
        when = F.when(F.col("event_time").isNotNull(), F.concat(F.lit('event_time: "'), F.col("event_time").cast("string"), F.lit('"\n'))).otherwise("")
        memories.select("date", F.concat(head, mood, tags, when, F.lit("---\n"), "content").alias("value")).write.mode("append").partitionBy("date").text(f"{self.path}/log")


def parse_entities(spark: SparkSession, text: str) -> DataFrame:
    """A JSON array of ``{name, type = TOPIC, confidence = 1.0}``; bad JSON or a missing name is an error."""
    return _parse(spark, text, ENTITY_INPUT, ["name"], {"type": "TOPIC", "confidence": 1.0})


def parse_relations(spark: SparkSession, text: str) -> DataFrame:
    """A JSON array of ``{source, target, rel_type = TOPICAL, weight = 0.5, evidence = ''}``."""
    return _parse(spark, text, RELATION_INPUT, ["source", "target"], {"rel_type": "TOPICAL", "weight": 0.5, "evidence": ""})


def _parse(spark: SparkSession, text: str, schema: str, keys: list[str], defaults: dict) -> DataFrame:
    rows = json.loads(text or "[]")
    if not isinstance(rows, list) or any(not isinstance(r, dict) or r.get(k) is None for r in rows for k in keys):
        raise ValueError(f"a JSON array of objects with {', '.join(keys)} is needed")
    parsed = spark.createDataFrame([(text or "[]",)], "j string").select(F.posexplode(F.from_json("j", schema, {"mode": "FAILFAST"})).alias("seq", "r")).select("seq", "r.*")
    return parsed.select("seq", *keys, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()])
