"""What the corpus operators share: tables, written intermediate tables, folds, bounded samples."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch may hold on its way to Python; texts are long, so the default of 10,000 is too many.
ARROW_ROWS = 512
#: Files at most of a table that a bounded sample gives, however many partitions the session's shuffles have.
SAMPLE_PARTS = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, by whatever file system the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Send this package to the executors, once per application; Spark's own file server hands it out."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    file = Path(tempfile.mkdtemp(prefix="tidemark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(file, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    context.addPyFile(str(file))
    _shipped.add(context.applicationId)


def bounded_batches(spark: SparkSession) -> None:
    """Before Python runs on executors: ship the package, and lower the session's Arrow batch size to ARROW_ROWS unless it is lower already."""
    shipped(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master may go without that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, which cuts the lineage; gone when the JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{what}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(schema).parquet(path)


@contextlib.contextmanager
def bloom_joins(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark makes a Bloom filter (8 MB at most, whatever the input) of a join's filtered side and applies it to the other side's scan."""
    prefix = "spark.sql.optimizer.runtime.bloomFilter."
    wanted = {"enabled": "true", "applicationSideScanSizeThreshold": "1b", "creationSideThreshold": "1t", "maxNumBits": "67108864", "maxNumItems": "8000000"}
    before = {k: spark.conf.get(prefix + k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(prefix + k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(prefix + k) if v is None else spark.conf.set(prefix + k, v)


def dropped(df: DataFrame) -> None:
    """Delete what written() wrote for df, when nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        at = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if at.getName().startswith("tidemark-"):
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()


def fold(column: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo parts; null ids count as remainder -1."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % parts, F.lit(-1))


def sampled_ids(labelled: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows of `labelled`, those of the smallest hash of `key`; the same ones on every run."""
    return labelled.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(rows)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A string column as Python strings, nulls as empty ones."""
    return [t or "" for t in batch.column(column).to_pylist()]


def slices(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about `limit` characters each, one text at least."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > limit:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor, shift, multiply) over uint64 values."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))
