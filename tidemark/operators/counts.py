"""Counts over recursive relations without their pairs.

A query that groups one end of a rule's relation and counts the other needs no pairs where each value has one step at most, as from a part to
its parent. Two rules are recognised: a transitive closure, and the values of one generation (equally many steps from a common value). All
values take 1, 2, 4... steps at once, by one join a round, so the rounds grow with the logarithm of the longest path and a round's rows with the
steps. A value reaches as many values as it has steps ahead; on its way into a cycle, those before the cycle and the cycle's own. Values are of one
generation if the same number of steps leads to the same end, or if as many steps as there are values lead to the same place in a cycle.

Other rules, limits on derived facts, and relations in which a value has two steps are left to rules.derive.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.edn import Var
from ..plans import ast
from ..sources.scratch import dropped, written
from .clauses import Context, X, Y, conjunction
from .frames import Frame
from .results import column_name
from .rules import _args, calls, closure_of, derive, needed


def _free(args: tuple) -> bool:
    """Whether arguments are variables, each another."""
    return all(isinstance(a, Var) and not a.wild for a in args) and len(set(args)) == len(args)


def _relation(c: object) -> object:
    return c.name if isinstance(c, ast.Call) else c.a if isinstance(c, ast.Pattern) else None


def generation_of(rules: list[ast.Rule]) -> tuple[object, bool] | None:
    """A clause of the step, and whether it goes from its second argument to its first, if the rules are exactly those of one generation."""
    if len(rules) != 2 or any(len(r.head) != 2 or not _free(r.head) for r in rules):
        return None
    name = rules[0].name
    start = next((r for r in rules if len(r.body) == 2 and name not in calls(r.body)), None)
    up = next((r for r in rules if r is not start), None)
    if start is None or up is None or len(up.body) != 3:
        return None
    own = [c for c in up.body if isinstance(c, ast.Call) and c.name == name]
    steps = [*start.body, *(c for c in up.body if c not in own)]
    if len(own) != 1 or len(steps) != 4 or len({(type(c), _relation(c)) for c in steps}) != 1 or _relation(steps[0]) is None:
        return None
    if any(len(_args(c)) != 2 or not _free(_args(c)) for c in (*steps, *own)) or isinstance(steps[0], ast.Pattern) and isinstance(steps[0].a, Var):
        return None
    for back in (False, True):
        ends = [_args(c)[::-1] if back else _args(c) for c in steps]
        (a, p), (b, q) = ends[:2]
        above = dict(ends[2:])
        if {a, b} == set(start.head) and p == q and p not in start.head and set(above) == set(up.head) and tuple(above[v] for v in up.head) == own[0].args and not set(own[0].args) & set(up.head):
            return steps[0], back
    return None


def counted(context: Context, rules: Mapping[str, list[ast.Rule]], q: ast.Query, base: Callable[[str], Frame | None]) -> DataFrame | None:
    """The rows of a query that groups one end of a recognised relation and counts the other; None for any other query."""
    keys = [f for f in q.find if isinstance(f, Var)]
    sums = [f for f in q.find if isinstance(f, ast.Aggregate) and f.func in ("count", "count-distinct")]
    if len(q.find) != 2 or len(keys) != 1 or len(sums) != 1 or q.grouped_with or q.max_derived or len(q.where) != 1 or not isinstance(call := q.where[0], ast.Call):
        return None
    if call.name not in rules or not _free(call.args) or set(call.args) != {keys[0], sums[0].var}:
        return None
    own = rules[call.name]
    closure, generation = closure_of(own), generation_of(own)
    if closure:
        step, back = closure.body[0], call.args[1] == keys[0]
    elif generation:
        step, back = generation
    else:
        return None
    if call.name in needed(rules, calls(step)):
        return None
    taken = base(call.name)
    if taken is not None and not taken.df.isEmpty():  # facts of the rule's own name
        return None
    ends = (ast.Call(step.name, (X, Y)) if isinstance(step, ast.Call) else ast.Pattern(X, step.a, Y),)
    inner = replace(context, derived=derive(context, rules, ends, base), rules=frozenset(rules))
    frame = conjunction(inner, ends, None, {X, Y})
    kinds = {k for k, _ in frame.columns.values()}
    if len(kinds) != 1 or kinds & {"any", "float"}:  # ends that don't unify by plain equality
        return None
    x, y = (frame.scope[v].col for v in ((Y, X) if back else (X, Y)))
    steps = written(frame.df.select(x.alias("x"), y.alias("y")).distinct(), "steps")
    if not steps.groupBy("x").count().where("count > 1").isEmpty():
        dropped(steps)
        return None
    found = _reached(steps) if closure else _generations(steps)
    return found.select(*(F.col("x" if f is keys[0] else "n").alias(column_name(f)) for f in q.find))


def _ends(steps: DataFrame) -> DataFrame:
    """For each x: where it gets (to) after n steps, which are all it has, or, if it goes on there, as many as there are steps at least."""
    going = steps.select(F.col("x").alias("y"), F.lit(True).alias("going"))
    first = steps.join(going, "y", "left").select("x", F.col("y").alias("to"), F.lit(1).cast("long").alias("n"), F.coalesce("going", F.lit(False)).alias("going"))
    state, made, all_steps = written(first, "ends"), 1, steps.count()
    while made < all_steps and not state.where("going").isEmpty():
        ahead = state.select(F.col("x").alias("_x"), F.col("to").alias("_to"), F.col("n").alias("_n"), F.col("going").alias("_going"))
        moved = state.where("going").join(ahead, F.col("to") == F.col("_x")).select("x", F.col("_to").alias("to"), (F.col("n") + F.col("_n")).alias("n"), F.col("_going").alias("going"))
        before, state = state, written(state.where(~F.col("going")).union(moved), "ends")
        dropped(before)
        made *= 2
    return state


def _cycles(steps: DataFrame, cyclic: DataFrame) -> DataFrame:
    """For each x of cyclic, all of which lie in cycles: the number of values in its cycle."""
    state = written(steps.join(cyclic, "x", "left_semi").select("x", F.col("y").alias("to"), F.col("x").alias("least")), "cycles")
    made, most = 1, cyclic.count()
    while made < most:  # the least value among as many as have been passed names the cycle in the end
        ahead = state.select(F.col("x").alias("_x"), F.col("to").alias("_to"), F.col("least").alias("_least"))
        moved = state.join(ahead, F.col("to") == F.col("_x")).select("x", F.col("_to").alias("to"), F.least("least", "_least").alias("least"))
        before, state = state, written(moved, "cycles")
        dropped(before)
        made *= 2
    return state.join(state.groupBy("least").agg(F.count(F.lit(1)).alias("length")), "least").select("x", "length")


def _reached(steps: DataFrame) -> DataFrame:
    """For each x: n, the number of values that one or more steps reach."""
    ends = _ends(steps)
    cyclic = ends.where("going").select(F.col("to").alias("x")).distinct()
    if ends.where("going").isEmpty():
        return ends.select("x", "n")
    cyclic = written(cyclic, "cyclic")
    dropped(ends)
    lengths = written(_cycles(steps, cyclic), "lengths")
    before = _ends(steps.join(cyclic, "x", "left_anti"))
    away = before.join(lengths.withColumnRenamed("x", "to"), "to", "left").select("x", (F.col("n") + F.coalesce(F.col("length") - 1, F.lit(0))).alias("n"))  # its last step is into the cycle
    return away.union(lengths.select("x", F.col("length").alias("n")))


def _generations(steps: DataFrame) -> DataFrame:
    """For each x: n, the number of values of its generation, itself included."""
    ends = _ends(steps)
    sizes = ends.groupBy("to", "n").agg(F.count(F.lit(1)).alias("size"))
    return ends.join(sizes, ["to", "n"]).select("x", F.col("size").alias("n"))
