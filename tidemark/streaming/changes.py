"""Streams over a log in a folder: its commits as they are published, and a table of current values kept from them.

The language has no streaming operators. What follows a log is its tail: every record once, by transaction. Records may be back-dated, so no
watermark drops any.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import temporal
from ..sources.log import SCHEMA


def tail(spark: SparkSession, path: str, since: int = 0, files_per_batch: int = 100) -> DataFrame:
    """A stream of the records after a transaction."""
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true")
    return source.parquet(f"{path.rstrip('/')}/commits").where(F.col("tx_count") > since)


def each_batch(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Run a function on each batch of new records; the checkpoint folder makes restarts go on where they ended."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def keep_current(spark: SparkSession, path: str, checkpoint: str, target: str, once: bool = True) -> StreamingQuery:
    """Keep the standing windows of every fact that changed, one folder a batch: readers take each fact's latest batch.

    A batch re-reduces only facts named in it, over their whole history, so late and corrected records are right.
    """

    def handle(batch: DataFrame, number: int) -> None:
        touched = batch.select("e", "a").distinct()
        history = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{path.rstrip('/')}/commits").join(touched, ["e", "a"], "left_semi").dropDuplicates()
        standing = temporal.net_windows(history).withColumn("gone", F.lit(False))
        gone = touched.join(standing.select("e", "a").distinct(), ["e", "a"], "left_anti").withColumn("gone", F.lit(True))
        standing.unionByName(gone, allowMissingColumns=True).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/b-{number}")

    return each_batch(tail(spark, path), checkpoint, handle, once)


def current(spark: SparkSession, target: str) -> DataFrame:
    """The table that keep_current() keeps."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(target)
    newest = rows.groupBy("e", "a").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["e", "a", "batch"]).where(~F.col("gone")).drop("batch", "gone")
