"""Values as Spark columns.

A Val has a kind and a column. Kinds known when a plan is built - string, int, float, bool, ref, kw, `ent:<relation>` (a row of a relation, its
column is the key) - have plain typed columns; `any` has a struct (t, i, d, s) with a tag per row. NULL is never a value: it means that an
expression failed for the row, or that a fact is absent. The storable nil is an `any` with tag 0.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .edn import Const, DatalogError

#: Tags of the log format (fixed values).
TAGS = {"nil": 0, "bool": 1, "int": 2, "float": 3, "string": 4, "kw": 5, "ref": 6}
KINDS = {v: k for k, v in TAGS.items()}
STRUCT = T.StructType([T.StructField("t", T.ByteType()), T.StructField("i", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("s", T.StringType())])
TYPES = {"string": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "ref": T.StringType(), "kw": T.StringType(), "any": STRUCT}
NAMESPACE = uuid.NAMESPACE_OID


@dataclass(frozen=True)
class Val:
    kind: str
    col: Column

    @property
    def numeric(self) -> bool:
        return self.kind in ("int", "float")

    @property
    def entity(self) -> bool:
        return self.kind.startswith("ent:")


def struct(tag: int | Column, i: Column | None = None, d: Column | None = None, s: Column | None = None) -> Column:
    tag = tag if isinstance(tag, Column) else F.lit(tag)
    none = lambda c, t: F.lit(None).cast(t) if c is None else c.cast(t)
    return F.struct(tag.cast("tinyint").alias("t"), none(i, "long").alias("i"), none(d, "double").alias("d"), none(s, "string").alias("s"))


def entity_id(keyword: str) -> str:
    """The uuid of an entity keyword: the uuid it spells, or a name-based one."""
    try:
        return str(uuid.UUID(keyword[1:]))
    except ValueError:
        return str(uuid.uuid5(NAMESPACE, keyword))


def uuid5(name: Column) -> Column:
    """Name-based uuid of a text, as Spark expressions."""
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.hex)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def keyword_entity(keyword: Column) -> Column:
    """entity_id() as Spark expressions."""
    spelled = F.lower(F.substring(keyword, 2, 36))
    is_uuid = keyword.rlike("^:[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")
    return F.when(is_uuid, spelled).otherwise(uuid5(keyword))


def literal(c: Const) -> Val:
    if c.kind == "nil":
        return Val("any", struct(0))
    return Val(c.kind, F.lit(c.value).cast(TYPES[c.kind]))


def boxed(v: Val) -> Column:
    """A value as a struct; a row of a relation becomes the ref of the keyword :<relation>/<key>."""
    if v.kind == "any":
        return v.col
    if v.entity:
        made = struct(TAGS["ref"], s=uuid5(F.concat(F.lit(f":{v.kind[4:]}/"), v.col.cast("string"))))
    elif v.kind == "bool":
        made = struct(TAGS["bool"], i=v.col.cast("int"))
    elif v.kind == "int":
        made = struct(TAGS["int"], i=v.col)
    elif v.kind == "float":
        made = struct(TAGS["float"], d=v.col)
    else:
        made = struct(TAGS[v.kind], s=v.col)
    return F.when(v.col.isNotNull(), made)


def as_any(v: Val) -> Val:
    return Val("any", boxed(v))


def node(v: Val) -> Val:
    """The value with a keyword turned into the ref of its entity, so that both join."""
    if v.kind == "kw":
        return Val("ref", keyword_entity(v.col))
    if v.kind == "any":
        t, s = v.col["t"], v.col["s"]
        return Val("any", F.when(t == TAGS["kw"], struct(TAGS["ref"], s=keyword_entity(s))).otherwise(v.col))
    return v


def joinable(a: Val, b: Val) -> tuple[Column, Column] | None:
    """Columns that are equal exactly if the values unify across patterns; None if they can't."""
    if a.kind == b.kind and a.kind != "any" and a.kind != "float":
        return a.col, b.col
    if a.kind == b.kind == "float":
        return F.when(~F.isnan(a.col), a.col), F.when(~F.isnan(b.col), b.col)
    if a.kind == "any" or b.kind == "any":
        return boxed(node(as_any(a))), boxed(node(as_any(b)))
    if {a.kind, b.kind} == {"kw", "ref"}:
        return node(a).col, node(b).col
    for x, y in ((a, b), (b, a)):
        if x.entity and y.kind in ("ref", "kw"):
            mine, other = boxed(x)["s"], node(y).col
            return (mine, other) if x is a else (other, mine)
    return None


def same(a: Val, b: Val) -> Column:
    """Structural equality: kinds matter, NaN equals nothing."""
    both = a.col.isNotNull() & b.col.isNotNull()
    if a.kind != "any" and b.kind != "any":
        if a.kind != b.kind:
            if a.entity and b.kind == "ref" or b.entity and a.kind == "ref":
                return same(as_any(a), as_any(b))
            return F.when(both, F.lit(False))
        if a.kind == "float":
            return F.when(both, (a.col == b.col) & ~F.isnan(a.col))
        return a.col == b.col
    x, y = boxed(a), boxed(b)
    nan = F.coalesce(F.isnan(x["d"]), F.lit(False))
    return F.when(both, (x == y) & ~nan)


def is_kind(v: Val, *kinds: str) -> Column:
    """Whether a value is of one of these kinds; null where it failed."""
    if v.kind == "any":
        return v.col["t"].isin(*(TAGS[k] for k in kinds))
    own = "ref" if v.entity else v.kind
    return F.when(v.col.isNotNull(), F.lit(own in kinds))


def integer(v: Val) -> Column:
    """The value as a long, null if it isn't an integer."""
    if v.kind == "any":
        return F.when(v.col["t"] == TAGS["int"], v.col["i"])
    return v.col if v.kind == "int" else F.lit(None).cast("long")


def number(v: Val) -> Column:
    """The value as a double, null if it isn't numeric."""
    if v.kind == "any":
        return F.when(v.col["t"] == TAGS["int"], v.col["i"].cast("double")).when(v.col["t"] == TAGS["float"], v.col["d"])
    return v.col.cast("double") if v.numeric else F.lit(None).cast("double")


def text(v: Val) -> Column:
    """The value as a string, null if it isn't one."""
    if v.kind == "any":
        return F.when(v.col["t"] == TAGS["string"], v.col["s"])
    return v.col if v.kind == "string" else F.lit(None).cast("string")


def truthy(v: Val) -> Column:
    """True, and numbers other than zero."""
    if v.kind == "bool":
        return v.col
    if v.numeric:
        return v.col != 0
    if v.kind == "any":
        t = v.col["t"]
        return F.when(t.isin(1, 2), v.col["i"] != 0).when(t == 3, v.col["d"] != 0).otherwise(F.lit(False))
    return F.when(v.col.isNotNull(), F.lit(False))


def unboxed(row: object) -> object:
    """A collected struct as a Python value: keywords and refs as (kind, text)."""
    if row is None:
        return None
    kind = KINDS[row["t"]]
    if kind in ("kw", "ref"):
        return (kind, row["s"])
    return {"nil": None, "bool": bool(row["i"]) if row["i"] is not None else None, "int": row["i"], "float": row["d"], "string": row["s"]}[kind]


def require(kind: str, what: str, *allowed: str) -> None:
    if kind != "any" and kind not in allowed:
        raise DatalogError(f"{what} doesn't take values of kind {kind}")
