"""What is true in a fact log as of a transaction, at a valid time or over all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.times import ALL_TIME, FOREVER
from ..sources.log import identity, value_of

#: Instants are milliseconds below this.
_INSTANTS = 1 << 53


def as_of(log: DataFrame, tx_count: int | None = None, tx_ms: int | None = None) -> DataFrame:
    """Records up to a transaction number or instant."""
    if tx_count is not None:
        return log.where(F.col("tx_count") <= tx_count)
    return log if tx_ms is None else log.where(F.col("tx_id") <= max(0, tx_ms))


def net_windows(log: DataFrame) -> DataFrame:
    """One row per window (e, a, v, valid_from, valid_to) that still stands: asserted later than any retraction of it, with the newest assertion's metadata.

    A retraction of all windows counts against each; any other against the window of just its bounds.

    Records are dealt once by fact, and both steps work on that; the buffers are numbers (transaction and instant packed in a decimal), so groups
    are hashed, and the value comes back from its identity.
    """
    everything = ~F.col("asserted") & (F.col("valid_from") == ALL_TIME) & (F.col("valid_to") == FOREVER)
    keyed = log.withColumn("vkey", identity()).repartition("e", "a", "vkey")
    latest = lambda c, x="tx_count": F.max(F.when(c, F.col(x)))
    grouped = keyed.withColumn("stamp", F.col("tx_count") * F.lit(_INSTANTS).cast("decimal(20,0)") + F.col("tx_id")).groupBy("e", "a", "vkey", "valid_from", "valid_to").agg(
        latest(F.col("asserted"), "stamp").alias("put"),
        latest(~F.col("asserted") & ~everything).alias("cut"),
        latest(everything).alias("cut_all"),
    )
    over = Window.partitionBy("e", "a", "vkey")
    standing = grouped.withColumn("cut_all", F.max("cut_all").over(over)).where(F.col("put").isNotNull())
    standing = standing.withColumn("tx_id", F.pmod("put", F.lit(_INSTANTS).cast("decimal(20,0)")).cast("long"))
    standing = standing.withColumn("tx_count", ((F.col("put") - F.col("tx_id")) / F.lit(_INSTANTS).cast("decimal(20,0)")).cast("long"))
    standing = standing.where(F.col("tx_count") > F.greatest(F.coalesce("cut", F.lit(-1)), F.coalesce("cut_all", F.lit(-1))))
    return standing.select("e", "a", value_of("vkey").alias("v"), "vkey", "tx_id", "tx_count", "valid_from", "valid_to")


def valid_at(windows: DataFrame, ms: int | Column) -> DataFrame:
    """The windows that hold an instant, one per fact: overlapping windows of a fact count once."""
    held = windows.where((F.col("valid_from") <= ms) & (F.lit(ms) < F.col("valid_to")))
    return held.dropDuplicates(["e", "a", "vkey"])
