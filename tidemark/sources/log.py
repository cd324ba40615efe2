"""The fact log: rows of (entity, attribute, value, transaction, valid time, asserted), append-only.

MemoryLog keeps rows of small commits on the driver and bulk commits as written tables. ParquetLog keeps a folder of commits; a commit is written aside,
its number claimed, and it is published by one rename, so readers see it whole or not at all, and a second writer of the same number fails.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.edn import Const
from ..functions.times import ALL_TIME, FOREVER
from ..functions.values import STRUCT, TAGS
from . import scratch

FIELDS = [
    T.StructField("e", T.StringType(), False),
    T.StructField("a", T.StringType(), False),
    T.StructField("v", STRUCT, False),
    T.StructField("tx_id", T.LongType(), False),
    T.StructField("tx_count", T.LongType(), False),
    T.StructField("valid_from", T.LongType(), False),
    T.StructField("valid_to", T.LongType(), False),
    T.StructField("asserted", T.BooleanType(), False),
    T.StructField("seq", T.LongType(), False),
]
SCHEMA = T.StructType(FIELDS)


def value_row(c: Const) -> tuple:
    """A literal as the log's value struct."""
    t = TAGS[c.kind]
    return (t, int(c.value) if c.kind in ("int", "bool") else None, c.value if c.kind == "float" else None, c.value if c.kind in ("string", "kw", "ref") else None)


def identity(v: str = "v"):
    """Text that is equal exactly for the same value: NaNs are one, zeros of either sign are two."""
    x = F.col(v)
    return F.concat_ws(":", x["t"].cast("string"), F.coalesce(x["i"].cast("string"), x["d"].cast("string"), x["s"], F.lit("")))


def value_of(key: str) -> Column:
    """The value struct that an identity was made from."""
    t = F.substring_index(key, ":", 1).cast("byte")
    rest = F.expr(f"substring({key}, instr({key}, ':') + 1)")
    kinds = lambda *names: t.isin(*(TAGS[n] for n in names))
    fields = t.alias("t"), F.when(kinds("int", "bool"), rest.cast("long")).alias("i"), F.when(kinds("float"), rest.cast("double")).alias("d"), F.when(kinds("string", "kw", "ref"), rest).alias("s")
    return F.struct(*fields)


class MemoryLog:
    """A log without a folder; bulk commits are written to the shared folder, so that they don't change with their source."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.rows: list[tuple] = []
        self.frames: list[DataFrame] = []
        self.head = 0
        self._frame: DataFrame | None = None

    def read(self) -> DataFrame:
        if self._frame is None:
            self._frame = self.spark.createDataFrame(self.rows, SCHEMA)
            for f in self.frames:
                self._frame = self._frame.unionByName(f)
        return self._frame

    def append(self, rows: Iterable[tuple], tx_count: int) -> None:
        if tx_count != self.head + 1:
            raise ValueError("another writer was faster")
        self.rows += rows
        self.head, self._frame = tx_count, None

    def append_frame(self, df: DataFrame, tx_count: int) -> None:
        """A bulk commit; df has the log's columns."""
        if tx_count != self.head + 1:
            raise ValueError("another writer was faster")
        self.frames.append(scratch.written(df.select(*SCHEMA.fieldNames()), "commit"))
        self.head, self._frame = tx_count, None


class ParquetLog:
    """A log in a folder: <path>/commits/c-<first tx>-<last tx>/*.parquet, partitioned by nothing and sorted by attribute and entity.

    A writer claims its first number by making the file <path>/claims/<first tx>, which one writer only can, and then moves its commit in. A claim
    without a commit for STALE_MS is of a writer that died, and falls to the next. Compacted logs lie beside the commits in <path>/compacted, so readers
    that were opened before and streams over the commits go on as they were; vacuum() deletes what a compacted log covers, when none of them needs it.
    """

    STALE_MS = 60_000

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.head = 0
        self.refresh()

    def refresh(self) -> None:
        """See what other writers have published."""
        self.head = max((last for _, last, _ in self._ranges()), default=0)

    def _all(self) -> list[tuple[int, int, str]]:
        found = [(kind, n) for kind in ("compacted", "commits") for n in scratch.listed(self.spark, f"{self.path}/{kind}") if n.startswith("c-")]
        return [(*map(int, n.split("-")[1:]), f"{self.path}/{kind}/{n}") for kind, n in found]

    def _ranges(self) -> list[tuple[int, int, str]]:
        """First and last transaction and folder of what makes up the log: nothing that another one covers."""
        out: list[tuple[int, int, str]] = []
        for part in sorted(self._all(), key=lambda p: (p[0], -p[1])):
            if not out or part[1] > out[-1][1]:
                out.append(part)
        return out

    def read(self) -> DataFrame:
        paths = [path for _, _, path in self._ranges()]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def append(self, rows: Iterable[tuple], tx_count: int) -> None:
        self.append_frame(self.spark.createDataFrame(list(rows), SCHEMA).coalesce(1), tx_count)

    def append_frame(self, df: DataFrame, tx_count: int, first: int | None = None) -> None:
        first = first or tx_count
        head = self.head
        self.refresh()  # a lost race leaves the writer at the head it lost to, so that its next try can win
        if first != self.head + 1 or head != self.head:
            raise ValueError("another writer was faster")
        try:
            self._publish(df, first, tx_count)
        except FileExistsError:
            self.refresh()
            raise ValueError("another writer was faster") from None
        self.head = tx_count

    def _publish(self, df: DataFrame, first: int, last: int, kind: str = "commits") -> None:
        import uuid

        aside = f"{self.path}/writing/{uuid.uuid4().hex}"
        df.select(*SCHEMA.fieldNames()).sortWithinPartitions("a", "e").write.parquet(aside)
        try:
            if kind == "commits" and not scratch.claimed(self.spark, f"{self.path}/claims/{first}", self.STALE_MS, lambda: first <= max((b for _, b, _ in self._all()), default=0)):
                raise FileExistsError(f"transaction {first} is taken")
            scratch.rename(self.spark, aside, f"{self.path}/{kind}/c-{first}-{last}")
        except FileExistsError:
            scratch.delete(self.spark, aside)
            raise

    def compact(self, partitions: int = 8) -> bool:
        """Write all that is committed as one part, range-partitioned by attribute and entity, beside the commits; whether there was anything to do."""
        old = self._ranges()
        if len(old) < 2:
            return False
        self._publish(self.read().repartitionByRange(partitions, "a", "e"), old[0][0], old[-1][1], "compacted")
        return True

    def vacuum(self) -> int:
        """Delete what compacted parts cover, and say how many folders went; for times when no reader or stream that began before the compaction still runs."""
        live = {path for _, _, path in self._ranges()}
        gone = [path for _, _, path in self._all() if path not in live]
        for path in gone:
            scratch.delete(self.spark, path)
        return len(gone)

    def backup(self, target: str) -> int:
        """Copy what is committed to a fresh folder; the last transaction it holds."""
        if scratch.exists(self.spark, target):
            raise FileExistsError(f"{target} exists")
        copy = ParquetLog(self.spark, target)
        if self.head:
            copy._publish(self.read(), 1, self.head)
        return self.head


def export(log: DataFrame, since: int = 0) -> DataFrame:
    """Records after a transaction, in the order they were written."""
    return log.where(F.col("tx_count") > since).orderBy("tx_count", "seq")


def valid_time(record: DataFrame) -> DataFrame:
    """Records with valid_time in the export form: valid_to null while open, scope "all" for retractions of all windows."""
    everything = (F.col("valid_from") == ALL_TIME) & (F.col("valid_to") == FOREVER) & ~F.col("asserted")
    return record.withColumn("scope", F.when(everything, "all").otherwise("window")).withColumn("valid_to", F.when(F.col("valid_to") != FOREVER, F.col("valid_to")))
