"""From bindings to results: grouped aggregates, running windows, projection. Results are bags."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.edn import DatalogError, Var
from ..functions.values import TAGS, TYPES, Val, number, require, struct
from ..plans import ast
from ..plans.parser import AGGREGATES, WINDOWS
from .frames import Frame, fresh

_LONG = ((1 << 63) - 1, -(1 << 63))


@dataclass(frozen=True)
class UserAggregate:
    """An aggregate in Python: init() -> state, step(state, value) -> state, finish(state, n) -> value, of kind `kind`.

    Values come as plain Python values; nil as None. Grouped use runs over Arrow batches of a group.
    """

    init: Callable[[], object]
    step: Callable[[object, object], object]
    finish: Callable[[object, int], object]
    kind: str = "float"

    def fold(self, values: pd.Series, keep_nil: bool) -> object:
        state, n = self.init(), 0
        for x in values:
            if isinstance(x, dict):
                x = {0: None, 1: bool(x["i"]), 2: x["i"], 3: x["d"]}.get(x["t"], x["s"])
            elif isinstance(x, float) and pd.isna(x) or x is pd.NA:
                x = None if self.kind != "float" else x
            if x is not None or keep_nil:
                state, n = self.step(state, x), n + 1
        return self.finish(state, n) if n else None

    def udf(self, keep_nil: bool):
        return F.pandas_udf(lambda v: self.fold(v, keep_nil), TYPES[self.kind], F.PandasUDFType.GROUPED_AGG)


def column_name(f: object) -> str:
    """The result's name of a :find element."""
    if isinstance(f, Var):
        return f.name
    if isinstance(f, ast.Aggregate):
        return f"({f.func} {f.var.name})"
    return f"({f.func}{' ' + f.var.name if f.var else ''} :over ...)"


def _present(v: Val) -> Column:
    """The column, null where the value is nil."""
    return F.when(v.col["t"] != TAGS["nil"], v.col) if v.kind == "any" else v.col


def _checked(v: Val, what: str, *kinds: str) -> Val:
    """The value; a run that meets another kind (but nil) fails."""
    require(v.kind, what, *kinds)
    if v.kind != "any":
        return v
    fine = v.col["t"].isin(TAGS["nil"], *(TAGS[k] for k in kinds))
    return Val("any", F.when(fine, v.col).otherwise(F.raise_error(F.lit(f"{what} met a value of a wrong kind")).cast(TYPES["any"])))


def _clamped(total: Column) -> Column:
    return F.least(F.greatest(total, F.lit(_LONG[1]).cast("decimal(38,0)")), F.lit(_LONG[0]).cast("decimal(38,0)")).cast("long")


def _sum(v: Val, what: str, distinct: bool) -> Val:
    """Integers saturate; one float makes the sum a float; without a value it's the integer 0."""
    add = F.sum_distinct if distinct else F.sum
    v = _checked(v, what, "int", "float")
    if v.kind == "int":
        return Val("int", F.coalesce(_clamped(add(v.col.cast("decimal(38,0)"))), F.lit(0).cast("long")))
    if v.kind == "float":
        return Val("float", F.coalesce(add(v.col), F.lit(0.0)))
    t = v.col["t"]
    ints = F.coalesce(add(F.when(t == TAGS["int"], v.col["i"]).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    floats = add(F.when(t == TAGS["float"], v.col["d"]))
    return Val("any", F.when(floats.isNull(), struct(TAGS["int"], i=_clamped(ints))).otherwise(struct(TAGS["float"], d=floats + ints.cast("double"))))


def _extreme(v: Val, what: str, func) -> Val:
    """Least or greatest; a group must be of one kind."""
    v = _checked(v, what, "int", "float", "string")
    if v.kind != "any":
        return Val(v.kind, func(v.col))
    t = v.col["t"]
    tags = F.collect_set(F.when(t != TAGS["nil"], t))
    value = func(F.when(t != TAGS["nil"], v.col))
    return Val("any", F.when(F.size(tags) <= 1, value).otherwise(F.raise_error(F.lit(f"{what} met values of different kinds")).cast(TYPES["any"])))


def aggregate_column(func: str, v: Val, users: dict[str, UserAggregate]) -> Val:
    """One aggregate over a group."""
    if func == "count":
        return Val("int", F.count(_present(v)))
    if func == "count-distinct":
        return Val("int", F.count_distinct(_present(v)))
    if func in ("sum", "sum-distinct"):
        return _sum(v, func, func.endswith("distinct"))
    if func in ("min", "max"):
        return _extreme(v, func, F.min if func == "min" else F.max)
    if func in users:
        return Val(users[func].kind, users[func].udf(False)(v.col))
    raise DatalogError(f"unknown aggregate {func!r}")


def aggregated(frame: Frame, q: ast.Query, users: dict[str, UserAggregate]) -> tuple[Frame, dict[object, tuple[str, str]]]:
    """Groups by the plain variables of :find and, without windows, by :with."""
    specs = [f for f in q.find if isinstance(f, ast.Aggregate)]
    windows = any(isinstance(f, ast.Windowed) for f in q.find)
    keys = list(dict.fromkeys([f for f in q.find if isinstance(f, Var)] + ([] if windows else list(q.grouped_with))))
    scope, made, out = frame.scope, [], {}
    for f in dict.fromkeys(specs):
        val, name = aggregate_column(f.func, scope[f.var], users), fresh(f.func.replace("-", "_"))
        made.append(val.col.alias(name))
        out[f] = (val.kind, name)
    seen = fresh("rows")
    kept = {k: frame.columns[k] for k in keys}
    if any(f.func in users for f in specs):  # Python and built-in aggregates don't mix in one step
        df = frame.df.groupBy(*(c for _, c in kept.values())).agg(*made)
        if not keys:
            df = df.where(F.lit(not frame.df.isEmpty()))
    else:
        df = frame.df.groupBy(*(c for _, c in kept.values())).agg(*made, F.count(F.lit(1)).alias(seen))
        if not keys and not all(f.func == "count" for f in specs):
            df = df.where(F.col(seen) > 0)
    for f in specs:
        if f.func in ("min", "max"):
            df = df.where(F.col(out[f][1]).isNotNull())  # a group of nils has no least value
    return Frame(df, kept), out


def window_column(w: ast.Windowed, scope: dict[Var, Val], users: dict[str, UserAggregate]) -> Val:
    """A running function: from the first row of the partition to this one."""
    def order_key(v: Val) -> list[Column]:
        if v.kind != "any":
            return [v.col]
        t = v.col["t"]
        rank = F.when(t.isin(TAGS["int"], TAGS["float"]), TAGS["int"]).otherwise(t)
        return [rank, F.coalesce(number(v), F.lit(0.0)), v.col["s"], v.col["i"]]

    if w.order not in scope:
        raise DatalogError(f"{w.order.name} is lost when rows are grouped")
    order = [c.desc_nulls_last() if w.desc else c.asc_nulls_first() for c in order_key(scope[w.order])]
    parts = [scope[w.partition].col] if w.partition in scope else []
    over = Window.partitionBy(*parts).orderBy(*order)
    if w.func in ("rank", "row-number"):
        return Val("int", (F.rank() if w.func == "rank" else F.row_number()).over(over).cast("long"))
    rows = over.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = scope[w.var] if w.var in scope else Val("any", struct(0))
    if w.func == "count":
        return Val("int", F.count(_present(v)).over(rows))
    if w.func == "avg":
        return Val("float", F.avg(number(v)).over(rows))
    if w.func == "sum":
        if v.kind == "int":
            return Val("int", _clamped(F.sum(v.col.cast("decimal(38,0)")).over(rows)))
        if v.kind == "float":
            return Val("float", F.sum(v.col).over(rows))
        floats = F.count(F.when(v.col["t"] == TAGS["float"], 1)).over(rows) if v.kind == "any" else F.lit(0)
        total = F.coalesce(F.sum(number(v)).over(rows), F.lit(0.0))
        return Val("any", F.when(floats > 0, struct(TAGS["float"], d=total)).otherwise(struct(TAGS["int"], i=total.cast("long"))))
    if w.func in ("min", "max"):
        func = F.min if w.func == "min" else F.max
        if v.kind != "any":
            return Val(v.kind, func(v.col).over(rows))
        key = F.struct(F.when(v.col["t"].isin(2, 3), 2).otherwise(v.col["t"]).alias("k"), number(v).alias("n"), v.col["s"].alias("s"), v.col.alias("v"))
        return Val("any", func(F.when(v.col["t"] != 0, key)).over(rows)["v"])
    if w.func in users:
        return Val(users[w.func].kind, users[w.func].udf(True)(v.col).over(rows))
    raise DatalogError(f"unknown window function {w.func!r}")


def finished(frame: Frame, q: ast.Query, users: dict[str, UserAggregate]) -> DataFrame:
    """Group, then windows, then the columns of :find in order."""
    for f in q.find:
        if isinstance(f, ast.Aggregate) and f.func not in AGGREGATES and f.func not in users or isinstance(f, ast.Windowed) and f.func not in WINDOWS and f.func not in users:
            raise DatalogError(f"unknown function {f.func!r}")
    made: dict[object, tuple[str, str]] = {}
    if any(isinstance(f, ast.Aggregate) for f in q.find):
        frame, made = aggregated(frame, q, users)
    df = frame.df
    for f in q.find:
        if isinstance(f, ast.Windowed) and f not in made:
            scope = frame.scope | {g.var: Val(kind, F.col(c)) for g, (kind, c) in made.items() if isinstance(g, ast.Aggregate) and g.var not in frame.columns}
            val, name = window_column(f, scope, users), fresh("window")
            df = df.withColumn(name, val.col)
            made[f] = (val.kind, name)
    names = functools.reduce(lambda out, f: [*out, column_name(f) if column_name(f) not in out else f"{column_name(f)} {len(out)}"], q.find, [])
    return df.select(*(F.col(frame.columns[f][1] if isinstance(f, Var) else made[f][1]).alias(n) for f, n in zip(q.find, names, strict=True)))
