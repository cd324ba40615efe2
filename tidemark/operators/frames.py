"""Bindings as DataFrames: one column per variable, and how bindings are joined."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.edn import Var
from ..functions.values import Val, as_any, joinable

_names = itertools.count()


def fresh(stem: str) -> str:
    """A column name that nothing else has."""
    return f"{stem}_{next(_names)}"


@dataclass
class Frame:
    """A DataFrame and which of its columns holds which variable."""

    df: DataFrame
    columns: dict[Var, tuple[str, str]]  # variable -> (kind, column)

    @property
    def scope(self) -> dict[Var, Val]:
        return {v: Val(kind, F.col(c)) for v, (kind, c) in self.columns.items()}

    @staticmethod
    def of(df: DataFrame, values: Mapping[Var, Val], where: Iterable[Column] = ()) -> Frame:
        """Select values from a DataFrame under fresh names, keeping rows for which all conditions hold."""
        for c in where:
            df = df.where(c)
        named = {v: (x.kind, fresh(v.name.strip("?").replace(".", "_").replace("`", "_")), x.col) for v, x in values.items()}
        made = df.select(*(c.alias(n) for _, n, c in named.values())) if named else df.select(F.lit(1).alias(fresh("row")))
        return Frame(made, {v: (kind, n) for v, (kind, n, _) in named.items()})

    def project(self, keep: Iterable[Var], distinct: bool = False) -> Frame:
        """Only some variables, under fresh names (so that the result can be joined to this frame)."""
        out = Frame.of(self.df, {v: self.scope[v] for v in keep if v in self.columns})
        return Frame(out.df.distinct(), out.columns) if distinct else out

    def extend(self, var: Var, val: Val) -> Frame:
        """With a variable bound to a value, where there is one."""
        name = fresh(var.name.strip("?"))
        df = self.df.withColumn(name, val.col).where(F.col(name).isNotNull())
        return Frame(df, self.columns | ({} if var.wild else {var: (val.kind, name)}))


def _condition(a: Frame, b: Frame, on: Iterable[Var]) -> Column | None:
    """Equality of shared variables; None without any."""
    parts = []
    for v in on:
        pair = joinable(a.scope[v], b.scope[v])
        parts.append(pair[0] == pair[1] if pair else F.lit(False))
    return functools.reduce(lambda x, y: x & y, parts) if parts else None


def join(a: Frame | None, b: Frame) -> Frame:
    """Natural join; of shared variables the first frame's columns stay. Frames without a shared variable give their product."""
    if a is None:
        return b
    shared = [v for v in b.columns if v in a.columns]
    condition = _condition(a, b, shared)
    df = a.df.crossJoin(b.df) if condition is None else a.df.join(b.df, condition)
    df = df.drop(*(b.columns[v][1] for v in shared))
    return Frame(df, a.columns | {v: c for v, c in b.columns.items() if v not in a.columns})


def anti(a: Frame, b: Frame, on: Iterable[Var]) -> Frame:
    """The rows of a without a match in b; with no variable to match on, no rows if b has any."""
    condition = _condition(a, b, on)
    df = a.df.join(b.df.limit(1), F.lit(True), "left_anti") if condition is None else a.df.join(b.df, condition, "left_anti")
    return Frame(df, a.columns)


def semi(a: Frame, b: Frame, on: Iterable[Var]) -> Frame:
    condition = _condition(a, b, on)
    return Frame(a.df.join(b.df, condition, "left_semi"), a.columns)


def union(frames: list[Frame], order: list[Var], distinct: bool = True) -> Frame:
    """Frames one after the other; a variable of different kinds becomes `any`."""
    kinds = {}
    for v in order:
        own = {f.columns[v][0] for f in frames}
        kinds[v] = own.pop() if len(own) == 1 else "any"
    names = {v: fresh(v.name.strip("?")) for v in order}
    parts = []
    for f in frames:
        columns = [(as_any(f.scope[v]) if kinds[v] == "any" else f.scope[v]).col.alias(names[v]) for v in order]
        parts.append(f.df.select(*columns) if columns else f.df.select(F.lit(1).alias("row")))
    df = functools.reduce(DataFrame.union, parts)
    return Frame(df.distinct() if distinct else df, {v: (kinds[v], names[v]) for v in order})
