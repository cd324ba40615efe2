"""Recursive rules with stratified negation, by semi-naive rounds.

Rules are grouped into strata: a predicate stands above those it negates, and predicates that depend on each other are computed together. In
a round, each recursive rule is evaluated once per recursive call, with that call reading only what the round before found new. A round's
relations are written to the shared folder, so plans don't grow and a lost executor costs no recomputation of earlier rounds.

Two forms are recognised. A transitive closure (a base rule, and the same steps followed or preceded by the relation itself) asked for whole doubles
its paths each round. Where a query calls a rule with a constant that every recursive call passes through unchanged, or that can be by
turning a closure's direction, only what starts from the constant is derived.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.edn import Const, DatalogError, Var
from ..functions.values import Val, as_any, boxed, joinable
from ..plans import ast
from ..sources.scratch import written
from .clauses import Context, X, Y, _matches, conjunction
from .frames import Frame

#: Rounds after which a fixpoint is given up.
MOST_ROUNDS = 1000


def calls(form: object) -> set[str]:
    """Names of rules or attributes, without the colon, that clauses call or match."""
    if isinstance(form, ast.Call):
        return {form.name}
    if isinstance(form, ast.Pattern):
        return {form.a.value[1:]} if isinstance(form.a, Const) else set()
    if isinstance(form, (tuple, list)):
        return set().union(*map(calls, form)) if form else set()
    if isinstance(form, (ast.Not, ast.NotJoin)):
        return calls(form.body)
    if isinstance(form, (ast.Or, ast.OrJoin)):
        return calls(form.branches)
    return set()


def _negated(form: object) -> set[str]:
    if isinstance(form, (ast.Not, ast.NotJoin)):
        return calls(form.body)
    if isinstance(form, (ast.Or, ast.OrJoin)):
        return _negated(form.branches)
    if isinstance(form, (tuple, list)):
        return set().union(*map(_negated, form)) if form else set()
    return set()


def strata(rules: Iterable[ast.Rule]) -> dict[str, int]:
    """The stratum of each predicate; a cycle through a negation is an error."""
    rules = list(rules)
    level = {r.name: 0 for r in rules}
    for _ in range(len(level) + 1):
        changed = False
        for r in rules:
            no = _negated(r.body)
            need = max([level[r.name], *(level[c] for c in calls(r.body) if c in level), *(level[c] + 1 for c in no if c in level)])
            if need > level[r.name]:
                level[r.name], changed = need, True
        if not changed:
            return level
    raise DatalogError("rules are recursive through a negation")


def needed(rules: Mapping[str, list[ast.Rule]], names: set[str]) -> set[str]:
    """The predicates that calls of some names reach."""
    seen: set[str] = set()
    todo = [n for n in names if n in rules]
    while todo:
        if (n := todo.pop()) not in seen:
            seen.add(n)
            todo += [c for r in rules[n] for c in calls(r.body) if c in rules]
    return seen


def _components(rules: Mapping[str, list[ast.Rule]], names: set[str]) -> list[set[str]]:
    """Predicates that depend on each other, callees first."""
    reach = {n: needed(rules, {c for r in rules[n] for c in calls(r.body)}) & names for n in names}
    out, left = [], set(names)
    while left:
        ready = next(n for n in sorted(left) if not {m for m in reach[n] & left if n not in reach[m]} - {n})
        group = {ready} | {m for m in left if ready in reach[m] and m in reach[ready]}
        out.append(group)
        left -= group
    return out


def _head(frame: Frame, rule: ast.Rule) -> Frame:
    values = {v: frame.scope[h] for v, h in zip((X, Y), rule.head, strict=False)}
    return Frame.of(frame.df, values)


def _unified(frames: list[Frame]) -> tuple[dict[Var, str], list[DataFrame]]:
    """Frames over X (and Y) with common kinds and the columns x, y."""
    kinds = {}
    for v in frames[0].columns:
        own = {f.columns[v][0] for f in frames}
        kinds[v] = own.pop() if len(own) == 1 else "any"
    name = {X: "x", Y: "y"}
    return kinds, [f.df.select(*((as_any(f.scope[v]) if kinds[v] == "any" else f.scope[v]).col.alias(name[v]) for v in kinds)) for f in frames]


def _frame(df: DataFrame, kinds: dict[Var, str]) -> Frame:
    return Frame(df, {v: (k, {X: "x", Y: "y"}[v]) for v, k in kinds.items()})


def _split(body: tuple, target: set[str]) -> list[int]:
    """Positions of a body's positive calls of the targets."""
    return [i for i, c in enumerate(body) if isinstance(c, ast.Call) and c.name in target or isinstance(c, ast.Pattern) and isinstance(c.a, Const) and c.a.value[1:] in target]


def _args(c: object) -> tuple:
    return c.args if isinstance(c, ast.Call) else (c.e, c.v)


def closure_of(rules: list[ast.Rule]) -> ast.Rule | None:
    """The base rule, if the rules are exactly a transitive closure of its one step."""
    if len(rules) != 2 or any(len(r.head) != 2 for r in rules):
        return None
    name = rules[0].name
    base = next((r for r in rules if len(r.body) == 1 and isinstance(r.body[0], (ast.Pattern, ast.Call)) and name not in calls(r.body)), None)
    step = next((r for r in rules if r is not base), None)
    if base is None or step is None or len(step.body) != 2 or not all(isinstance(c, (ast.Pattern, ast.Call)) for c in step.body):
        return None
    own = _split(step.body, {name})
    if len(own) != 1:
        return None
    call, edge = step.body[own[0]], step.body[1 - own[0]]
    if type(edge) is not type(base.body[0]) or (edge.name != base.body[0].name if isinstance(edge, ast.Call) else edge.a != base.body[0].a):
        return None
    a, b = step.head
    ends = [_args(call), _args(edge)]
    if any(len(e) != 2 or not all(isinstance(t, Var) and not t.wild for t in e) for e in ends) or _args(base.body[0]) != base.head or a == b:
        return None
    first, second = (ends[0], ends[1]) if ends[0][0] == a else (ends[1], ends[0])
    return base if first[0] == a and second[1] == b and first[1] == second[0] and first[1] not in (a, b) else None


def _kept_positions(name: str, rules: list[ast.Rule]) -> set[int]:
    """Argument positions that every recursive call of a predicate by itself passes on from the head."""
    kept = {0, 1}
    for r in rules:
        for c in (r.body[i] for i in _split(r.body, {name})):
            kept &= {k for k in (0, 1) if k < len(r.head) and k < len(_args(c)) and _args(c)[k] == r.head[k]}
    return kept


def _all_calls(form: object, name: str) -> list[object]:
    """Every call of a predicate, wherever it stands."""
    if isinstance(form, (tuple, list)):
        return [c for f in form for c in _all_calls(f, name)]
    if isinstance(form, (ast.Not, ast.NotJoin)):
        return _all_calls(form.body, name)
    if isinstance(form, (ast.Or, ast.OrJoin)):
        return _all_calls(form.branches, name)
    if isinstance(form, ast.Pattern) and isinstance(form.a, Var):
        return [form]  # may match any predicate
    return [form] if isinstance(form, (ast.Call, ast.Pattern)) and name in calls(form) else []


def _demand(name: str, query: tuple, rules: Mapping[str, list[ast.Rule]], group: set[str]) -> dict[int, Const]:
    """Constants that all calls of a predicate agree on, if only the query calls it."""
    if group != {name} or any(_all_calls(r.body, name) for n, rs in rules.items() if n != name for r in rs):
        return {}
    found = _all_calls(query, name)
    if not found or any(isinstance(c, ast.Pattern) and isinstance(c.a, Var) for c in found):
        return {}
    out = {}
    for k in (0, 1):
        own = {_args(c)[k] if k < len(_args(c)) else None for c in found}
        if len(own) == 1 and isinstance(only := own.pop(), Const):
            out[k] = only
    return out


def derive(context: Context, rules: Mapping[str, list[ast.Rule]], query: tuple, base: Callable[[str], Frame | None], most_derived: int | None = None) -> dict[str, Frame]:
    """Relations of all predicates that the query's clauses reach, as frames over X and Y."""
    names = needed(rules, calls(query) | (set(rules) if any(isinstance(c, ast.Pattern) and isinstance(c.a, Var) for c in query) else set()))
    strata([r for n in names for r in rules[n]])
    derived: dict[str, Frame] = {}
    for group in _components(rules, names):
        found = _fixpoint(replace(context, derived=dict(derived), rules=frozenset(rules)), {n: rules[n] for n in group}, base, {n: _demand(n, query, {m: rules[m] for m in names}, group) for n in group}, most_derived)
        derived |= found
    return derived


def _filtered(frame: Frame, demand: dict[int, Const]) -> Frame:
    df = frame.df
    for k, c in demand.items():
        if (v := (X, Y)[k]) in frame.columns:
            df = df.where(_matches(frame.scope[v], c))
    return Frame(df, frame.columns)


def _fixpoint(context: Context, rules: dict[str, list[ast.Rule]], base: Callable[[str], Frame | None], demand: dict[str, dict[int, Const]], most: int | None) -> dict[str, Frame]:
    """The relations of predicates that depend on each other."""
    group = set(rules)
    start: dict[str, list[Frame]] = {}
    recursive: list[tuple[ast.Rule, int]] = []
    allowed: dict[str, dict[int, Const]] = {}
    for name, own in rules.items():
        closure = closure_of(own)
        kept = {0, 1} if closure else _kept_positions(name, own)
        allowed[name] = {k: c for k, c in demand[name].items() if k in kept}
        if closure and allowed[name]:
            allowed[name] = dict([min(allowed[name].items())])  # the other end is matched by the query
        start[name] = [f for f in [base(name)] if f is not None]
        for r in own:
            at = _split(r.body, group)
            if not at:
                start[name].append(_head(conjunction(context, r.body, None, set(r.head)), r))
            recursive += [(r, i) for i in at]
    if not recursive and all(not calls(r.body) & group for own in rules.values() for r in own):
        out = {}
        for name, frames in start.items():
            kinds, parts = _unified([_filtered(f, allowed[name]) for f in frames])
            df = parts[0]
            for p in parts[1:]:
                df = df.union(p)
            out[name] = _frame(df.distinct(), kinds)
        return out
    return _iterate(context, rules, start, recursive, allowed, most)


def _iterate(context: Context, rules: dict, start: dict[str, list[Frame]], recursive: list, allowed: dict, most: int | None, general: bool = False) -> dict[str, Frame]:
    """Rounds until nothing is new. general: all relations hold values of any kind."""
    kinds: dict[str, dict[Var, str]] = {}
    total: dict[str, DataFrame] = {}
    only = next(iter(rules)) if len(rules) == 1 and closure_of(next(iter(rules.values()))) else None
    for name, frames in start.items():
        if not frames:
            continue
        filtered = frames if only else [_filtered(f, allowed[name]) for f in frames]
        if general:
            filtered = [Frame.of(f.df, {v: as_any(x) for v, x in f.scope.items()}) for f in filtered]
        kinds[name], parts = _unified(filtered)
        df = parts[0]
        for p in parts[1:]:
            df = df.union(p)
        total[name] = written(df.distinct(), "derived")
    while missing := [n for n in rules if n not in total]:  # predicates without a start begin empty, of the kinds that a rule will give
        ready = next(((n, r) for n in missing for r in rules[n] if not calls(r.body) & set(missing)), None)
        if ready is None:
            from .clauses import _one_row

            of = {v: Val("any", boxed(Val("int", F.lit(0).cast("long")))) for v in (X, Y)}
            for n in missing:
                head = Frame.of(_one_row(context), {v: of[v] for v in (X, Y)[: len(rules[n][0].head)]})
                kinds[n], (df,) = _unified([head])
                total[n] = df.limit(0)
            continue
        name, rule = ready
        head = _head(conjunction(replace(context, derived=dict(context.derived) | {n: _frame(total[n], kinds[n]) for n in total}), rule.body, None, set(rule.head)), rule)
        kinds[name], (df,) = _unified([Frame.of(head.df, {v: as_any(x) if general else x for v, x in head.scope.items()})])
        total[name] = written(df.limit(0), "derived")
    delta = dict(total)
    if only:
        return {only: _closure(total[only], kinds[only], allowed[only], most)}
    for _ in range(MOST_ROUNDS):
        made: dict[str, list[Frame]] = {n: [] for n in rules}
        for rule, at in recursive:
            derived = dict(context.derived) | {n: _frame(total[n], kinds[n]) for n in rules}
            body = list(rule.body)
            c = body[at]
            body[at] = ast.Call("\0new", _args(c))
            name = c.name if isinstance(c, ast.Call) else c.a.value[1:]
            derived["\0new"] = _frame(delta[name], kinds[name])
            made[rule.name].append(_head(conjunction(replace(context, derived=derived), tuple(body), None, set(rule.head)), rule))
        for rule in (r for own in rules.values() for r in own if not _split(r.body, set(rules)) and calls(r.body) & set(rules)):  # recursion inside or, or-join
            made[rule.name].append(_head(conjunction(replace(context, derived=dict(context.derived) | {n: _frame(total[n], kinds[n]) for n in rules}), rule.body, None, set(rule.head)), rule))
        if not general and any(f.columns[v][0] != k for n, fs in made.items() for f in fs for v, k in kinds[n].items()):
            return _iterate(context, rules, start, recursive, allowed, most, True)
        delta = {}
        for n, frames in made.items():
            columns = list(total[n].columns)
            new = total[n].limit(0)
            for f in frames:
                _, (part,) = _unified([Frame.of(f.df, {v: as_any(x) if general else x for v, x in f.scope.items()})])
                new = new.union(part)
            delta[n] = written(new.distinct().join(total[n], columns, "left_anti").select(*columns), "new")
            total[n] = total[n].union(delta[n])
        sizes = {n: d.count() for n, d in delta.items()}
        if most and sum(sizes.values()) > most:
            raise DatalogError(f"more than {most} facts were derived in a round")
        if not any(sizes.values()):
            return {n: _frame(total[n], kinds[n]) for n in rules}
    raise DatalogError(f"no fixpoint after {MOST_ROUNDS} rounds")


def _steps(left: DataFrame, right: DataFrame, kinds: dict[Var, str]) -> DataFrame:
    """Paths of a left path and a right one that begins where it ends."""
    a = left.select(F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = right.select(F.col("x").alias("bx"), F.col("y").alias("by"))
    pair = joinable(Val(kinds[Y], F.col("ay")), Val(kinds[X], F.col("bx")))
    return a.join(b, pair[0] == pair[1] if pair else F.lit(False)).select(F.col("ax").alias("x"), F.col("by").alias("y"))


def _closure(edges: DataFrame, kinds: dict[Var, str], demand: dict[int, Const], most: int | None) -> Frame:
    """All paths, by doubling; with a demanded end, only the paths from or to it, edge by edge."""
    total = delta = edges
    if demand:
        total = delta = written(_filtered(_frame(edges, kinds), demand).df, "paths")
    for _ in range(MOST_ROUNDS):
        if 0 in demand:
            made = _steps(delta, edges, kinds)
        elif demand:
            made = _steps(edges, delta, kinds)
        else:
            made = _steps(delta, total, kinds).union(_steps(total, delta, kinds))
        delta = written(made.distinct().join(total, ["x", "y"], "left_anti").select("x", "y"), "paths")
        n = delta.count()
        if most and n > most:
            raise DatalogError(f"more than {most} facts were derived in a round")
        if not n:
            return _frame(total, kinds)
        total = total.union(delta) if demand else written(total.union(delta), "closure")
    raise DatalogError(f"no fixpoint after {MOST_ROUNDS} rounds")
