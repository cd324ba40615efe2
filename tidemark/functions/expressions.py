"""Scalar operators on values. An operand of a wrong type, a division by zero or a NaN result makes the result NULL, which drops the row."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import ast
from .edn import Const, DatalogError, Slot, Var
from .values import TAGS, Val, integer, is_kind, literal, number, same, struct, text

Predicates = Mapping[str, Callable[[Column], Column]]
_LEAST = -(1 << 63)
_TESTS = {"string?": "string", "integer?": "int", "float?": "float", "boolean?": "bool", "nil?": "nil"}


def _wrapped(op: str, a: Column, b: Column) -> Column:
    """Two's complement arithmetic: plain where it fits, by decimals where it overflows."""
    plain = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b)
    x, y = a.cast("decimal(19,0)"), b.cast("decimal(19,0)")
    wide = {"+": x + y, "-": x - y, "*": x * y}[op].cast("decimal(38,0)")
    half, full = F.lit(str(1 << 63)).cast("decimal(38,0)"), F.lit(str(1 << 64)).cast("decimal(38,0)")
    return F.coalesce(plain, (F.pmod(wide + half, full) - half).cast("long"))


def _int_divided(a: Column, b: Column) -> Column:
    """Truncated quotient; null for a zero divisor and for the one quotient that doesn't fit."""
    safe = F.when((b != 0) & ~((b == -1) & (a == _LEAST)), b)
    return F.call_function("div", a, safe)


def _floats(op: str, a: Column, b: Column) -> Column:
    if op == "/":
        made = F.when((b != 0) & ~F.isnan(b), a / b)
    else:
        made = {"+": a + b, "-": a - b, "*": a * b}[op]
    return F.when(~F.isnan(made), made)


def arithmetic(op: str, a: Val, b: Val) -> Val:
    """Integers stay integers; a float on either side makes a float."""
    if not {a.kind, b.kind} <= {"int", "float", "any"}:
        return Val("int", F.lit(None).cast("long"))
    floats = _floats(op, number(a), number(b))
    if "float" in (a.kind, b.kind):
        return Val("float", floats)
    whole = _int_divided(integer(a), integer(b)) if op == "/" else _wrapped(op, integer(a), integer(b))
    if a.kind == b.kind == "int":
        return Val("int", whole)
    ints = integer(a).isNotNull() & integer(b).isNotNull()
    return Val("any", F.when(ints & whole.isNotNull(), struct(TAGS["int"], i=whole)).when(~ints & floats.isNotNull(), struct(TAGS["float"], d=floats)))


def compare(op: str, a: Val, b: Val) -> Val:
    """Numbers only; two integers compare exactly, others as floats, and NaN as nothing."""
    of = lambda x, y: {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
    if a.kind == b.kind == "int":
        return Val("bool", of(a.col, b.col))
    x, y = number(a), number(b)
    floats = F.when(x.isNotNull() & y.isNotNull(), of(x, y) & ~F.isnan(x) & ~F.isnan(y))
    if "any" not in (a.kind, b.kind):
        return Val("bool", floats)
    i, j = integer(a), integer(b)
    return Val("bool", F.when(i.isNotNull() & j.isNotNull(), of(i, j)).otherwise(floats))


def strings(op: str, a: Val, b: Val) -> Val:
    x, y = text(a), text(b)
    return Val("bool", {"starts-with?": F.startswith, "ends-with?": F.endswith, "contains?": F.contains}[op](x, y))


def evaluate(expr: object, scope: Mapping[Var, Val], predicates: Predicates) -> Val:
    """The value of an expression over variables in scope."""
    if isinstance(expr, Var):
        if expr not in scope:
            raise DatalogError(f"{expr.name} isn't bound")
        return scope[expr]
    if isinstance(expr, Const):
        return literal(expr)
    if isinstance(expr, Slot):
        raise DatalogError(f"${expr.name} has no value; prepare the query and pass one")
    op = expr.op
    args = [evaluate(a, scope, predicates) for a in expr.args]
    if op in ("=", "!="):
        equal = same(*args)
        return Val("bool", equal if op == "=" else ~equal)
    if op in ("<", ">", "<=", ">="):
        return compare(op, *args)
    if op in ("+", "-", "*", "/"):
        return arithmetic(op, *args)
    if op in ("starts-with?", "ends-with?", "contains?"):
        return strings(op, *args)
    if op == "matches?":
        return Val("bool", text(args[0]).rlike(expr.args[1].value))
    if op in _TESTS:
        return Val("bool", is_kind(args[0], _TESTS[op]))
    if op in predicates:
        return Val("bool", predicates[op](args[0].col))
    raise DatalogError(f"unknown predicate {op!r}")


def check_known(form: object, predicates: Predicates, builtin: frozenset[str]) -> None:
    """Raise for operators that nothing defines, before a plan is built."""
    if isinstance(form, ast.Apply):
        if form.op not in builtin and form.op not in predicates:
            raise DatalogError(f"unknown predicate {form.op!r}")
        for a in form.args:
            check_known(a, predicates, builtin)
