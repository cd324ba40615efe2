"""Relations as sources of attributes: a column is an attribute, a row an entity, a foreign key a reference.

Nothing is exploded into facts: patterns on one entity variable become one scan of the columns they name (see operators.clauses).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import Val


@dataclass(frozen=True)
class Attribute:
    """Column expression and kind of an attribute; for references the kind is ent:<relation>."""

    kind: str
    column: Column


@dataclass
class Relation:
    """A table, its key column (None: rows have no key of their own), and its attributes by name."""

    name: str
    load: Callable[[], DataFrame]
    key: str | None
    attributes: dict[str, Attribute] = field(default_factory=dict)

    def scan(self, keyed: bool) -> DataFrame:
        """The table, with a key if asked for. Keyless rows are numbered among equal rows, so that the key is the same on every read."""
        df = self.load()
        if keyed and self.key is None:
            row = F.struct(*df.columns)
            df = df.withColumn("_hash", F.xxhash64(*df.columns))
            from pyspark.sql import Window

            same = Window.partitionBy("_hash", *df.columns[:-1]).orderBy(F.lit(0))
            df = df.withColumn("_key", F.xxhash64("_hash", F.row_number().over(same), row)).drop("_hash")
        return df

    @property
    def key_column(self) -> Column:
        return F.col(self.key).cast("long") if self.key else F.col("_key")

    def entity(self) -> Val:
        return Val(f"ent:{self.name}", self.key_column)


def millis_of(timestamp: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), timestamp.cast("timestamp_ntz"))
    return F.call_function("div", micros - F.pmod(micros, F.lit(1000)), F.lit(1000).cast("long"))


def attributes(prefix: str, /, **columns: str) -> dict[str, Attribute]:
    """Attributes :prefix/name from name="column kind [target]"; kind ms turns a timestamp into milliseconds."""
    out = {}
    for name, spec in columns.items():
        column, kind, *target = spec.split()
        c = F.col(column)
        if kind == "ms":
            c, kind = millis_of(c), "int"
        elif kind == "ent":
            c, kind = c.cast("long"), f"ent:{target[0]}"
        elif kind == "int":
            c = c.cast("long")
        elif kind == "float":
            c = c.cast("double") + F.lit(0.0)  # no negative zeros
        out[f":{prefix}/{name.replace('_', '-')}"] = Attribute(kind, c)
    return out


def star_schema(spark: SparkSession, folder: str) -> list[Relation]:
    """The relations of a data folder of order tables, events and documents."""

    def relation(name: str, table: str, key: str | None, /, **columns: str) -> Relation:
        return Relation(name, lambda: spark.read.parquet(f"{folder}/{table}.parquet"), key, attributes(name, **columns))

    return [
        relation("region", "region", "r_regionkey", name="r_name string"),
        relation("nation", "nation", "n_nationkey", name="n_name string", region="n_regionkey ent region"),
        relation("customer", "customer", "c_custkey", name="c_name string", acctbal="c_acctbal float", mktsegment="c_mktsegment string", nation="c_nationkey ent nation"),
        relation("supplier", "supplier", "s_suppkey", name="s_name string", acctbal="s_acctbal float", nation="s_nationkey ent nation"),
        relation("part", "part", "p_partkey", name="p_name string", brand="p_brand string", type="p_type string", size="p_size int", retailprice="p_retailprice float"),
        relation("order", "orders", "o_orderkey", status="o_orderstatus string", totalprice="o_totalprice float", orderdate="o_orderdate ms", priority="o_orderpriority string", customer="o_custkey ent customer"),
        relation(
            "lineitem", "lineitem", None, linenumber="l_linenumber int", quantity="l_quantity float", extendedprice="l_extendedprice float", discount="l_discount float",
            tax="l_tax float", returnflag="l_returnflag string", linestatus="l_linestatus string", shipdate="l_shipdate ms", order="l_orderkey ent order", part="l_partkey ent part", supplier="l_suppkey ent supplier",
        ),
        relation("event", "events", "event_id", user="user_id int", type="event_type string", value="value float", ts="ts ms"),
        relation("doc", "documents", "doc_id", text="text string", lang="lang string", source="source string", n_chars="n_chars int"),
    ]
