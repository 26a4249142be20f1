"""Shared storage for intermediate tables.

Everything that cuts lineage goes through the folder named by ``spark.checkpoint.dir``: a lost
executor then costs a re-read, not a recomputation, and no process relies on another one's disk.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application; they need it to run its functions."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    archive = f"{tempfile.mkdtemp(prefix='quernel-code-')}/quernel.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; in local mode, where one machine is all there is, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='quernel-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def staged_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quernel/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again; lineage ends here."""
    spark = df.sparkSession
    path = staged_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_KEPT: dict[tuple[str, str], tuple[str, object]] = {}


def kept(spark: SparkSession, name: str, make) -> DataFrame:
    """A table that an application makes once and then reads: ``make()``, written to the shared folder."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _KEPT:
        made = make()
        path = staged_path(spark, "kept")
        made.write.parquet(path)
        _KEPT[key] = path, made.schema
    path, schema = _KEPT[key]
    return spark.read.schema(schema).parquet(path)


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def path_exists(spark: SparkSession, name: str) -> bool:
    fs, path = _path(spark, name)
    return fs.exists(path)


def delete_path(spark: SparkSession, name: str) -> None:
    fs, path = _path(spark, name)
    fs.delete(path, True)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that no later plan reads."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete_path(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done: it does so once the driver's JVM
    has collected their objects, which may not happen by itself while a long job goes on."""
    spark._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
