"""Intermediate tables written to the folder that all executors share, instead of lineage that grows or blocks that die with an executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local master may go without that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back; deleted when the JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{what}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    at, fs = _at(spark, path)
    fs.deleteOnExit(at)
    return spark.read.schema(schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete what written() wrote for df, when nothing reads it any more."""
    for file in df.inputFiles()[:1]:
        at, fs = _at(df.sparkSession, file)
        if at.getParent().getName().startswith("tidemark-"):
            fs.delete(at.getParent(), True)


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def claimed(spark: SparkSession, path: str, stale_ms: int, used: Callable[[], bool]) -> bool:
    """Make an empty file that one caller only can make. One that is older than stale_ms, and that used() says nothing came of, is given away again."""
    at, fs = _at(spark, path)
    fs.mkdirs(at.getParent())
    if not fs.createNewFile(at):
        age = spark.sparkContext._jvm.System.currentTimeMillis() - fs.getFileStatus(at).getModificationTime()
        if age < stale_ms or used() or not fs.delete(at, False) or not fs.createNewFile(at):
            return False
    return not used()


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Move a folder to a name that must be free."""
    (a, fs), (b, _) = _at(spark, old), _at(spark, new)
    fs.mkdirs(b.getParent())
    if fs.exists(b) or not fs.rename(a, b):
        raise FileExistsError(f"{new} can't be published")


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names inside a folder, in order."""
    at, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
