"""A small evaluator of the language over Python tuples, to test the engine against.

Facts are (e, a, v) with entities and values as plain Python values; no time. Bindings are dicts.
"""

from __future__ import annotations

from tidemark.functions.edn import Const, Var
from tidemark.plans import ast


def _term(term, binding):
    if isinstance(term, Const):
        return True, term.value
    return (term in binding and not term.wild), binding.get(term)


def _match(terms, row, binding):
    out = dict(binding)
    for term, value in zip(terms, row, strict=False):
        known, own = _term(term, out)
        if known:
            if type(own) is not type(value) or own != value:
                return None
        elif not term.wild:
            out[term] = value
    return out


def _value(expr, binding):
    if isinstance(expr, Var):
        return binding[expr]
    if isinstance(expr, Const):
        return expr.value
    a, *b = (_value(x, binding) for x in expr.args)
    b = b[0] if b else None
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if expr.op in ("=", "!="):
        return (type(a) is type(b) and a == b) == (expr.op == "=")
    if not number(a) or not number(b):
        raise TypeError
    if expr.op == "/":
        return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1) if isinstance(a, int) and isinstance(b, int) else a / b
    return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b, "+": a + b, "-": a - b, "*": a * b}[expr.op]


def evaluate(clauses, facts, bindings, derived=None):
    """All bindings of a conjunction, as a list."""
    derived = derived or {}
    order = sorted(clauses, key=lambda c: (isinstance(c, (ast.Not, ast.NotJoin)), isinstance(c, (ast.Or, ast.OrJoin)), isinstance(c, (ast.Filter, ast.Bind))))
    late = [c for c in order if isinstance(c, (ast.Not, ast.NotJoin))]
    for c in [c for c in order if c not in late] + late:
        out = []
        for b in bindings:
            if isinstance(c, (ast.Pattern, ast.Call)):
                name = c.name if isinstance(c, ast.Call) else c.a.value[1:]
                args = c.args if isinstance(c, ast.Call) else (c.e, c.v)
                rows = [(e, v) for e, a, v in facts if a == f":{name}"] + list(derived.get(name, ()))
                out += [m for r in rows if (m := _match(args, r, b)) is not None]
            elif isinstance(c, (ast.Filter, ast.Bind)):
                try:
                    v = _value(c.expr, b)
                except (TypeError, ZeroDivisionError):
                    continue
                if isinstance(c, ast.Bind):
                    out.append(b | {c.out: v})
                elif v is True or not isinstance(v, bool) and v:
                    out.append(b)
            elif isinstance(c, ast.Not):
                if not evaluate(c.body, facts, [b], derived):
                    out.append(b)
            elif isinstance(c, ast.NotJoin):
                if not evaluate(c.body, facts, [{v: b[v] for v in c.on}], derived):
                    out.append(b)
            else:
                for branch in c.branches:
                    start = b if isinstance(c, ast.Or) else {v: b[v] for v in c.on}
                    for m in evaluate(branch, facts, [start], derived):
                        out.append(b | m if isinstance(c, ast.Or) else b)
        if isinstance(c, (ast.Or, ast.OrJoin)):
            out = [dict(x) for x in {tuple(sorted(m.items(), key=lambda kv: kv[0].name)) for m in out}]
        bindings = out
    return bindings


def fixpoint(rules, facts):
    """Relations of rules without negation through recursion, naively; strata by repeated passes over rules in order."""
    derived: dict[str, set] = {}
    while True:
        before = {n: set(s) for n, s in derived.items()}
        for r in rules:
            for b in evaluate(r.body, facts, [{}], derived):
                derived.setdefault(r.name, set()).add(tuple(b[v] for v in r.head))
        if before == derived:
            return derived
