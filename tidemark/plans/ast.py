"""Trees of commands."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.edn import Const, Slot, Var


@dataclass(frozen=True)
class Pattern:
    e: object
    a: object
    v: object


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Not:
    body: tuple


@dataclass(frozen=True)
class NotJoin:
    on: tuple[Var, ...]
    body: tuple


@dataclass(frozen=True)
class Or:
    branches: tuple[tuple, ...]


@dataclass(frozen=True)
class OrJoin:
    on: tuple[Var, ...]
    branches: tuple[tuple, ...]


@dataclass(frozen=True)
class Apply:
    """An operator on one or two arguments."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    expr: object


@dataclass(frozen=True)
class Bind:
    expr: object
    out: Var


@dataclass(frozen=True)
class Aggregate:
    func: str
    var: Var


@dataclass(frozen=True)
class Windowed:
    func: str
    var: Var | None
    partition: Var | None
    order: Var
    desc: bool


@dataclass(frozen=True)
class Query:
    find: tuple
    where: tuple = ()
    grouped_with: tuple[Var, ...] = ()
    as_of: object = None  # int, text or Slot
    valid_at: object = None  # text or Slot
    any_valid_time: bool = False
    max_results: int | None = None
    max_derived: int | None = None


@dataclass(frozen=True)
class Fact:
    e: Const
    a: str
    v: Const
    valid_from: str | None = None
    valid_to: str | None = None


@dataclass(frozen=True)
class Transact:
    facts: tuple[Fact, ...]


@dataclass(frozen=True)
class Retract:
    facts: tuple[Fact, ...]


@dataclass(frozen=True)
class Forget:
    at: str | None
    facts: tuple[Fact, ...] = ()
    query: Query | None = None


@dataclass(frozen=True)
class Rule:
    name: str
    head: tuple[Var, ...]
    body: tuple = field(default=())


def variables(form: object) -> set[Var]:
    """Variables that aren't wild, anywhere inside a term, expression or clause."""
    if isinstance(form, Var):
        return set() if form.wild else {form}
    if isinstance(form, (Const, Slot, str, int)) or form is None:
        return set()
    if isinstance(form, (tuple, list)):
        return set().union(*map(variables, form)) if form else set()
    return variables(tuple(getattr(form, f) for f in form.__dataclass_fields__))


def binds(clause: object) -> set[Var]:
    """Variables that a clause binds for those around it."""
    if isinstance(clause, (Pattern, Call)):
        return variables(clause)
    if isinstance(clause, Bind):
        return variables(clause.out)
    if isinstance(clause, Or):
        return set.intersection(*({v for c in b for v in binds(c)} for b in clause.branches))
    return set()
