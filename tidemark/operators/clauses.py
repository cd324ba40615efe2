"""Clauses as joins.

A conjunction is cut into units: all patterns with one entity term on one relation are a single scan (star fusion); patterns on the fact
log, with the metadata patterns that follow them, and calls of rules are a unit each. Units are joined in an order that keeps shared
variables and constants first; Catalyst chooses how. Expressions are applied as soon as their variables are bound; then come disjunctions,
what waited for them, and negations.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.edn import Const, DatalogError, Slot, Var
from ..functions.expressions import evaluate
from ..functions.values import TAGS, Val, boxed, entity_id, literal, same, struct, truthy
from ..plans import ast
from ..plans.parser import PSEUDO
from ..sources.relations import Relation
from .frames import Frame, anti, join, semi, union

#: Float constants in patterns match within this distance (a fixed value of the language).
EPSILON = 2.0**-52


@dataclass
class Context:
    """What clauses are compiled against."""

    relations: Mapping[str, Relation]  # by attribute
    facts: Callable[[frozenset[str] | None], DataFrame] | None  # reduced log, of some attributes or of all
    history: bool  # whether windows are kept apart, so that their metadata can be asked for
    instant: int | None  # the valid time of the query
    derived: Mapping[str, Frame] = field(default_factory=dict)  # rule relations: frames over X and Y
    predicates: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict)
    rules: frozenset[str] = frozenset()
    log_attributes: frozenset[str] | None = None  # None: not known, any name may be in the log


X, Y = Var("?x"), Var("?y")


def _matches(val: Val, term: object) -> Column | None:
    """The condition that a value matches a pattern's term; None for variables."""
    if isinstance(term, Var):
        return None
    if isinstance(term, Slot):
        raise DatalogError(f"${term.name} has no value; prepare the query and pass one")
    if term.kind == "float":
        if val.kind == "any":
            return (val.col["t"] == TAGS["float"]) & (F.abs(val.col["d"] - term.value) < EPSILON)
        return F.abs(val.col - term.value) < EPSILON if val.kind == "float" else F.lit(False)
    if val.entity:
        if term.kind not in ("kw", "ref"):
            return F.lit(False)
        name, _, key = str(term.value).lstrip(":").partition("/")
        if term.kind == "kw" and name == val.kind[4:] and key.lstrip("-").isdigit():
            return val.col == int(key)
        return boxed(val)["s"] == (entity_id(term.value) if term.kind == "kw" else term.value)
    if term.kind == "kw" and val.kind in ("ref", "any"):
        own = same(val, literal(term)) if val.kind == "any" else F.lit(False)
        return own | same(val, literal(Const("ref", entity_id(term.value))))
    return same(val, literal(term))


def _pattern_frame(df: DataFrame, parts: list[tuple[object, Val]]) -> Frame:
    """Match (term, value) pairs on one scan: constants filter, a variable that occurs twice must be equal raw."""
    values: dict[Var, Val] = {}
    where: list[Column] = []
    for term, val in parts:
        condition = _matches(val, term)
        if condition is not None:
            where.append(condition)
        elif not term.wild:
            if term in values:
                where.append(same(values[term], val))
            else:
                values[term] = val
    return Frame.of(df, values, where)


class Unit:
    """A scan that can be joined."""

    def __init__(self, bound: set[Var], constants: int, build: Callable[[], Frame]):
        self.bound, self.constants, self.build = bound, constants, build


def _relation_unit(relation: Relation, patterns: list[ast.Pattern]) -> Unit:
    e = patterns[0].e

    def build() -> Frame:
        df = relation.scan(keyed=not (isinstance(e, Var) and e.wild))
        for p in patterns:
            df = df.where(relation.attributes[p.a.value].column.isNotNull())  # a null column is no fact
        parts = [(p.v, Val(relation.attributes[p.a.value].kind, relation.attributes[p.a.value].column)) for p in patterns]
        if not (isinstance(e, Var) and e.wild):
            parts.insert(0, (e, relation.entity()))
        return _pattern_frame(df, parts)

    constants = sum(isinstance(p.v, Const) for p in patterns) + 2 * isinstance(e, Const)
    return Unit(ast.variables(tuple(patterns)), constants, build)


def _needs_key(e: Var, clauses: tuple, outside: set[Var], patterns: list[ast.Pattern]) -> bool:
    """Whether an entity variable is used anywhere but as the entity of one relation's patterns."""
    return e in outside or any(e in ast.variables(c) for c in clauses if not (isinstance(c, ast.Pattern) and c in patterns and c.e == e and c.v != e))


def _log_unit(context: Context, pattern: ast.Pattern, meta: list[ast.Pattern]) -> Unit:
    a = pattern.a

    def build() -> Frame:
        names = frozenset([a.value]) if isinstance(a, Const) else None
        df = context.facts(names)
        if names:
            df = df.where(F.col("a") == a.value)
        parts = [(pattern.e, Val("ref", F.col("e"))), (pattern.v, Val("any", F.col("v")))]
        if isinstance(a, Var):
            parts.insert(1, (a, Val("kw", F.col("a"))))
        parts += [(m.v, _metadata(context, m.a.value)) for m in meta]
        return _pattern_frame(df, parts)

    terms = (pattern.e, pattern.a, pattern.v)
    return Unit(ast.variables((pattern, tuple(m.v for m in meta))), sum(isinstance(t, Const) for t in terms), build)


def _metadata(context: Context, name: str) -> Val:
    if name == ":db/valid-at":
        return Val("any", struct(0)) if context.instant is None else Val("int", F.lit(context.instant).cast("long"))
    if not context.history:
        raise DatalogError(f"{name} needs :any-valid-time")
    return Val("int", F.col({":db/valid-from": "valid_from", ":db/valid-to": "valid_to", ":db/tx-count": "tx_count", ":db/tx-id": "tx_id"}[name]))


def _any_unit(context: Context, pattern: ast.Pattern) -> Unit:
    """A pattern whose attribute is a variable: the log and every relation, one row per attribute."""

    def build() -> Frame:
        frames = []
        if context.facts:
            frames.append(_log_unit(context, pattern, []).build())
        for relation in {id(r): r for r in context.relations.values()}.values():
            df = relation.scan(keyed=True)
            cells = [F.struct(F.lit(a).alias("a"), boxed(Val(x.kind, x.column)).alias("v")) for a, x in sorted(relation.attributes.items())]
            df = df.select(boxed(relation.entity()).alias("e"), F.explode(F.array(*cells)).alias("cell")).where(F.col("cell.v").isNotNull())
            frames.append(_pattern_frame(df, [(pattern.e, Val("any", F.col("e"))), (pattern.a, Val("kw", F.col("cell.a"))), (pattern.v, Val("any", F.col("cell.v")))]))
        for name, f in sorted(context.derived.items()):
            value = f.scope[Y] if Y in f.columns else Val("bool", F.lit(True))
            frames.append(_pattern_frame(f.df, [(pattern.e, f.scope[X]), (pattern.a, Val("kw", F.lit(f":{name}"))), (pattern.v, value)]))
        order = [v for v in dict.fromkeys((pattern.e, pattern.a, pattern.v)) if isinstance(v, Var) and not v.wild]
        return union(frames, order, distinct=False)

    return Unit(ast.variables(pattern), sum(isinstance(t, Const) for t in (pattern.e, pattern.v)), build)


def _derived_unit(context: Context, name: str, args: tuple) -> Unit:
    def build() -> Frame:
        f = context.derived[name]
        parts = [(args[0], f.scope[X])]
        if len(args) > 1:
            parts.append((args[1], f.scope[Y] if Y in f.columns else Val("bool", F.lit(True))))
        return _pattern_frame(f.df, parts)

    return Unit(ast.variables(args), sum(isinstance(a, Const) for a in args), build)


def _units(context: Context, clauses: tuple, outside: set[Var]) -> list[Unit]:
    """The scans of a conjunction. outside: variables that are used beyond it."""
    units: list[Unit] = []
    stars: dict[tuple, list[ast.Pattern]] = {}
    owners: list[tuple[ast.Pattern, list[ast.Pattern]]] = []
    for c in clauses:
        if isinstance(c, ast.Call):
            if not 1 <= len(c.args) <= 2:
                raise DatalogError(f"({c.name} ..) takes one or two arguments")
            if c.name in context.derived:
                units.append(_derived_unit(context, c.name, c.args))
                continue
            c = ast.Pattern(c.args[0], Const("kw", f":{c.name}"), c.args[1] if len(c.args) > 1 else Var("?_"))
            if c.a.value not in context.relations and context.facts is None:
                raise DatalogError(f"neither a rule nor an attribute: {c.a.value[1:]}")
        if not isinstance(c, ast.Pattern):
            continue
        a = c.a
        if isinstance(a, Var):
            units.append(_any_unit(context, c))
            continue
        if a.value in PSEUDO:
            owner = next((o for o in reversed(owners) if o[0].e == c.e), None)
            if owner:
                owner[1].append(c)
            elif a.value == ":db/valid-at":
                units.append(Unit(ast.variables(c.v), 3, lambda c=c: _pattern_frame(_one_row(context), [(c.v, _metadata(context, ":db/valid-at"))])))
            else:
                owners.append((ast.Pattern(c.e, Var("?_"), Var("?_")), [c]))
            continue
        if a.value[1:] in context.derived:
            units.append(_derived_unit(context, a.value[1:], (c.e, c.v)))
        elif a.value in context.relations:
            relation = context.relations[a.value]
            alone = isinstance(c.e, Var) and c.e.wild
            stars.setdefault((relation.name, len(stars) if alone else c.e), []).append(c)
        elif context.facts is None:
            raise DatalogError(f"unknown attribute {a.value}")
        else:
            owners.append((c, []))
    for patterns in stars.values():
        relation, e = context.relations[patterns[0].a.value], patterns[0].e
        if relation.key is None and isinstance(e, Var) and not e.wild and not _needs_key(e, clauses, outside, patterns):
            patterns = [ast.Pattern(Var("?_"), p.a, p.v) for p in patterns]  # one scan; rows need no name
        units.append(_relation_unit(relation, patterns))
    return units + [_log_unit(context, p, meta) for p, meta in owners]


def _one_row(context: Context) -> DataFrame:
    from pyspark.sql import SparkSession

    return SparkSession.active().range(1)


def _expressions(context: Context, frame: Frame | None, waiting: list) -> Frame | None:
    """Apply the expression clauses whose variables are bound; they leave the list."""
    again = True
    while again:
        again = False
        for c in list(waiting):
            if frame is not None and ast.variables(c.expr) <= frame.columns.keys() or frame is None and not ast.variables(c.expr):
                frame = frame or Frame(_one_row(context), {})
                value = evaluate(c.expr, frame.scope, context.predicates)
                if isinstance(c, ast.Filter):
                    frame = Frame(frame.df.where(F.coalesce(truthy(value), F.lit(False))), frame.columns)
                else:
                    frame = frame.extend(c.out, value)
                waiting.remove(c)
                again = True
    return frame


def _self_contained(body: tuple, on: set[Var] = frozenset()) -> bool:
    """Whether a body binds all that its expressions and negations, and the variables in `on`, need."""
    bound = {v for c in body if isinstance(c, (ast.Pattern, ast.Call)) for v in ast.variables(c)}
    again = True
    while again:
        more = {c.out for c in body if isinstance(c, ast.Bind) and ast.variables(c.expr) <= bound} - bound
        bound, again = bound | more, bool(more)
    need = set(on)
    for c in body:
        if isinstance(c, (ast.Filter, ast.Bind)):
            need |= ast.variables(c.expr)
        elif isinstance(c, ast.Not):
            need |= {v for x in c.body for v in ast.variables(x)}
        elif isinstance(c, (ast.NotJoin, ast.OrJoin)):
            need |= set(c.on)
        elif isinstance(c, ast.Or):
            if not all(_self_contained(b) for b in c.branches):
                return False
            bound |= ast.binds(c)
    return need <= bound and bool(bound)


def conjunction(context: Context, clauses: tuple, seed: Frame | None = None, outside: set[Var] | None = None) -> Frame:
    """The bindings of a conjunction, joined to the seed's. outside: variables whose values are used beyond; None for all."""
    need = set().union(*(ast.variables(c) for c in clauses)) if outside is None else outside
    units = _units(context, clauses, need)
    waiting = [c for c in clauses if isinstance(c, (ast.Filter, ast.Bind))]
    ors = [c for c in clauses if isinstance(c, (ast.Or, ast.OrJoin))]
    frame = _expressions(context, seed, waiting)
    while units:
        bound = set(frame.columns) if frame else set()
        best = max(units, key=lambda u: (bool(u.bound & bound) or not bound, u.constants, len(u.bound & bound)))
        if not best.bound & bound and (ready := next((o for o in ors if bound and isinstance(o, ast.Or) and ast.variables(o) & bound and ast.variables(o) & set().union(*(u.bound for u in units))), None)):
            frame = _expressions(context, disjunction(context, ready, frame), waiting)  # it may link what is left
            ors.remove(ready)
            continue
        units.remove(best)
        frame = _expressions(context, join(frame, best.build()), waiting)
    for c in ors:
        frame = disjunction(context, c, frame) if isinstance(c, ast.Or) else or_join(context, c, frame)
        frame = _expressions(context, frame, waiting)
    if waiting:
        raise DatalogError("an expression uses variables that aren't bound")
    for c in clauses:
        if isinstance(c, ast.Not):
            frame = negation(context, c, frame)
        elif isinstance(c, ast.NotJoin):
            frame = not_join(context, c, frame)
    if frame is None:
        raise DatalogError("a body needs a pattern")
    return frame


def negation(context: Context, clause: ast.Not, outer: Frame | None) -> Frame:
    """Rows for which the body has no match; an expression that fails doesn't match."""
    if outer is None:
        raise DatalogError("not needs bindings around it")
    body = clause.body
    if all(isinstance(c, ast.Filter) for c in body):
        for_all = F.lit(True)
        for c in body:
            for_all = for_all & F.coalesce(truthy(evaluate(c.expr, outer.scope, context.predicates)), F.lit(False))
        return Frame(outer.df.where(~for_all), outer.columns)
    shared = [v for v in outer.columns if v in ast.variables(body)]
    seed = None if _self_contained(body) else outer.project(shared, distinct=True)
    inner = conjunction(context, body, seed, set(shared))
    return anti(outer, inner.project(shared, distinct=False), [v for v in shared if v in inner.columns])


def not_join(context: Context, clause: ast.NotJoin, outer: Frame | None) -> Frame:
    """Rows without a match of the body on the join variables; all its other variables are its own."""
    if outer is None:
        raise DatalogError("not-join needs bindings around it")
    on = [v for v in clause.on if not v.wild]
    seed = None if _self_contained(clause.body) else outer.project(on, distinct=True)
    inner = conjunction(context, clause.body, seed, set(on))
    return anti(outer, inner.project(on), [v for v in on if v in inner.columns])


def disjunction(context: Context, clause: ast.Or, outer: Frame | None) -> Frame:
    """The union of the branches, as a set, joined to the bindings around it; the result is a set as well."""
    used = ast.variables(clause)
    shared = [v for v in outer.columns if v in used] if outer else []
    alone = all(_self_contained(b) for b in clause.branches)
    seed = outer.project(shared, distinct=True) if shared and not alone else None
    frames = [conjunction(context, b, seed, used) for b in clause.branches]
    common = set.intersection(*(set(f.columns) for f in frames))
    if alone and shared and any(set(shared) - set(f.columns) for f in frames):  # a branch leaves a shared variable open
        seed = outer.project(shared, distinct=True)
        frames = [conjunction(context, b, seed, used) for b in clause.branches]
        common = set.intersection(*(set(f.columns) for f in frames))
    order = [v for v in frames[0].columns if v in common and v in used]
    joined = join(outer, union(frames, order))
    return Frame(joined.df.dropDuplicates([c for _, c in joined.columns.values()]), joined.columns) if joined.columns else joined


def or_join(context: Context, clause: ast.OrJoin, outer: Frame | None) -> Frame:
    """Rows that some branch matches on the join variables, as a set; branches' other variables are their own."""
    if outer is None:
        raise DatalogError("or-join needs bindings around it")
    on = [v for v in clause.on if not v.wild]
    frames = []
    for b in clause.branches:
        seed = None if _self_contained(b, set(on)) else outer.project(on, distinct=True)
        frames.append(conjunction(context, b, seed, set(on)))
    kept = semi(outer, union(frames, on), on)
    return Frame(kept.df.dropDuplicates([c for _, c in kept.columns.values()]), kept.columns)

