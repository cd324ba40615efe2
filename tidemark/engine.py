"""The engine: commands in, DataFrames and receipts out."""

from __future__ import annotations

import base64
import json
import threading
import zlib
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, fields, is_dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.edn import Const, DatalogError, Slot, Var
from .functions.times import ALL_TIME, FOREVER, millis, now, text_of
from .functions.values import TAGS, Val, boxed, entity_id, node
from .operators import temporal
from .operators.clauses import Context, X, Y, conjunction
from .operators.counts import counted
from .operators.frames import Frame
from .operators.results import UserAggregate, finished
from .operators.rules import calls, derive, strata
from .plans import ast
from .plans.parser import AGGREGATES, BINARY, TYPE_TESTS, WINDOWS, parse
from .sources.log import SCHEMA, MemoryLog, ParquetLog, export, identity, value_row
from .sources.relations import Relation
from .sources.scratch import written


@dataclass(frozen=True)
class Receipt:
    """What a write did: transacted, retracted, forgotten or ok."""

    kind: str
    tx_id: int | None = None
    tx_count: int | None = None
    count: int | None = None


@dataclass(frozen=True)
class AnyTime:
    """Stands for :any-valid-time where a slot takes a valid time."""


ANY_TIME = AnyTime()


class Engine:
    """Queries over relations and a fact log (in memory, in a folder, or none)."""

    def __init__(self, spark: SparkSession, relations: Iterable[Relation] = (), log: MemoryLog | ParquetLog | None = None, clock: Callable[[], int] = now):
        self.spark, self.log, self.clock = spark, log, clock
        self.relations = {a: r for r in relations for a in r.attributes}
        self.rules: dict[str, list[ast.Rule]] = {}
        self.aggregates: dict[str, UserAggregate] = {}
        self.predicates: dict[str, Callable[[Column], Column]] = {}
        self._lock = threading.RLock()

    @staticmethod
    def memory(spark: SparkSession, clock: Callable[[], int] = now) -> Engine:
        """An engine with a log that isn't kept."""
        return Engine(spark, log=MemoryLog(spark), clock=clock)

    @staticmethod
    def open(spark: SparkSession, path: str, clock: Callable[[], int] = now) -> Engine:
        """An engine over a log in a folder, which is made with the first write."""
        return Engine(spark, log=ParquetLog(spark, path), clock=clock)

    # --- commands --------------------------------------------------------------------------------------------------

    def execute(self, text: str) -> DataFrame | Receipt:
        """Run one command: a query gives a DataFrame, the others a receipt."""
        return self.run(parse(text))

    def run(self, command: object) -> DataFrame | Receipt:
        if isinstance(command, ast.Query):
            return self.run_query(command)
        if isinstance(command, ast.Rule):
            return self.add_rule(command)
        if isinstance(command, ast.Forget):
            return self.forget(command)
        rows = [(type(command), f) for f in command.facts]
        with self._lock:
            tx, ms = self._next()
            self._log().append(stamped(rows, tx, ms), tx)
        return Receipt("transacted" if isinstance(command, ast.Transact) else "retracted", ms, tx, len(rows))

    def query(self, text: str) -> DataFrame:
        """Run a query command."""
        command = parse(text)
        if not isinstance(command, ast.Query):
            raise DatalogError("a query is expected")
        return self.run_query(command)

    def add_rule(self, rule: ast.Rule) -> Receipt:
        """Register a rule; one that makes negation recursive is refused and nothing changes."""
        if len(rule.head) > 2:
            raise DatalogError("a rule's head takes one or two variables")
        known = [r for rs in self.rules.values() for r in rs]
        if any(r.name == rule.name and len(r.head) != len(rule.head) for r in known):
            raise DatalogError(f"{rule.name} has another number of arguments already")
        strata([*known, rule])
        self.rules.setdefault(rule.name, []).append(rule)
        return Receipt("ok")

    # --- reading ---------------------------------------------------------------------------------------------------

    def run_query(self, q: ast.Query, log: DataFrame | None = None, instant: int | None = None, floor: int = 0) -> DataFrame:
        """A query's rows. log: read instead of the engine's own; instant: the valid time unless the query sets one."""
        self._known(q)
        at = None if q.any_valid_time else millis(q.valid_at) if isinstance(q.valid_at, str) else q.valid_at if q.valid_at is not None else instant if instant is not None else max(self.clock(), floor)
        facts = self._reducer(q.as_of, at, log) if self.log is not None or log is not None else None
        context = Context(self.relations, facts, q.any_valid_time, at, predicates=self.predicates)
        names, out = calls(q.where), None
        if self.rules and (names & set(self.rules) or any(isinstance(c, ast.Pattern) and isinstance(c.a, Var) for c in q.where)):

            def base(name: str) -> Frame | None:
                a = f":{name}"
                if a not in self.relations and facts is None:
                    return None
                arity = len(self.rules[name][0].head)
                body = (ast.Pattern(X, Const("kw", a), Y if arity == 2 else Var("?_")),)
                return conjunction(context, body, None, {X, Y}).project([X, Y][:arity], distinct=True)

            out = counted(context, self.rules, q, base)
            if out is None:
                context = replace(context, derived=derive(context, self.rules, q.where, base, q.max_derived))
        if out is None:
            needed = {v for f in q.find for v in ast.variables(f)} | set(q.grouped_with)
            out = finished(conjunction(context, q.where, None, needed), q, self.aggregates)
        if q.max_results is not None and out.limit(q.max_results + 1).count() > q.max_results:
            raise DatalogError(f"the query has more than {q.max_results} results")
        return out

    def _reducer(self, as_of: object, at: int | None, log: DataFrame | None) -> Callable[[frozenset[str] | None], DataFrame]:
        """Reduced facts by the attributes that are asked for; one reduction for all patterns with the same attributes."""
        made: dict[frozenset[str] | None, DataFrame] = {}

        def facts(names: frozenset[str] | None) -> DataFrame:
            if names not in made:
                df = self._log().read() if log is None else log
                df = df if names is None else df.where(F.col("a").isin(*sorted(names)))
                df = temporal.as_of(df, as_of if isinstance(as_of, int) else None, millis(as_of) if isinstance(as_of, str) else None)
                df = temporal.net_windows(df)
                made[names] = df if at is None else temporal.valid_at(df, at)
            return made[names]

        return facts

    def _known(self, form: object) -> None:
        """Raise for operators and slots that nothing gives a meaning, before any work."""
        if isinstance(form, Slot):
            raise DatalogError(f"${form.name} has no value; prepare the query and pass one")
        if isinstance(form, ast.Apply) and form.op not in BINARY | TYPE_TESTS and form.op not in self.predicates:
            raise DatalogError(f"unknown predicate {form.op!r}")
        if isinstance(form, (tuple, list)):
            for f in form:
                self._known(f)
        elif is_dataclass(form) and not isinstance(form, (Var, Const)):
            for f in fields(form):
                self._known(getattr(form, f.name))

    def prepare(self, text: str) -> Prepared:
        """Parse a query with $slots once, to be run with values."""
        command = parse(text)
        if not isinstance(command, ast.Query):
            raise DatalogError("only a query can be prepared")
        return Prepared(self, command)

    def read_view(self, as_of: int | None = None, valid_at: int | str | AnyTime | None = None) -> ReadView:
        """A bounded reader of one state: a transaction (now: the newest) and a valid time."""
        head = self._log().head
        if as_of is not None and as_of > head:
            raise DatalogError(f"transaction {as_of} is in the future")
        at = millis(valid_at) if isinstance(valid_at, str) else self.clock() if valid_at is None else valid_at
        return ReadView(self, head if as_of is None else as_of, None if isinstance(at, AnyTime) else at)

    def export_fact_log(self) -> DataFrame:
        return export(self._log().read())

    def export_fact_log_since(self, tx_count: int) -> DataFrame:
        if tx_count < 0:
            raise DatalogError("a transaction number can't be negative")
        return export(self._log().read(), tx_count)

    def current_projection(self, attributes: Sequence[str], path: str) -> DataFrame:
        """Materialise the standing windows of some attributes as a Parquet table, for repeated aggregates; it holds its watermark."""
        head = self._log().head
        windows = temporal.net_windows(self._log().read().where(F.col("a").isin(*attributes))).withColumn("watermark", F.lit(head))
        windows.write.mode("overwrite").partitionBy("a").parquet(path)
        return self.spark.read.parquet(path)

    # --- writing ---------------------------------------------------------------------------------------------------

    def begin(self) -> WriteTransaction:
        """Writes that are published together, or not at all."""
        return WriteTransaction(self)

    def batch(self, commands: Sequence[str]) -> Receipt:
        """Several write commands as one transaction."""
        if len(commands) > 256:
            raise DatalogError("a batch holds 256 commands at most")
        with self.begin() as tx:
            for c in commands:
                tx.execute(c)
        return tx.receipt

    def load(self, facts: DataFrame) -> Receipt:
        """A bulk commit of a DataFrame e, a, v (the log's value struct), and optionally valid_from and valid_to."""
        with self._lock:
            tx, ms = self._next()
            add = {"tx_id": F.lit(ms), "tx_count": F.lit(tx), "asserted": F.lit(True)}
            add |= {c: F.lit(d).cast("long") for c, d in (("valid_from", ms), ("valid_to", FOREVER)) if c not in facts.columns}
            df = facts.withColumns(add).select(*(F.col(f.name).cast(f.dataType) for f in SCHEMA.fields if f.name != "seq")).dropDuplicates()
            self._log().append_frame(df.withColumn("seq", F.monotonically_increasing_id()), tx)  # the order is fixed once it is written
        return Receipt("transacted", ms, tx)

    def forget(self, command: ast.Forget) -> Receipt:
        """Close the valid time of facts: windows that hold the instant end there."""
        with self._lock:
            head = self._log().head
            at = millis(command.at) if command.at else self.clock()
            windows = temporal.net_windows(self._log().read())
            if command.query:
                found = self.run_query(command.query, instant=at).toDF("e", "a", "v")
                entity = node(Val("any", F.col("e"))).col["s"] if isinstance(found.schema["e"].dataType, T.StructType) else F.col("e")
                attribute = F.col("a")["s"] if isinstance(found.schema["a"].dataType, T.StructType) else F.col("a")
                triples = found.select(entity.alias("e"), attribute.alias("a"), _as_struct(found.schema["v"]).alias("v"))
            else:
                triples = self.spark.createDataFrame([(_entity(f.e), f.a, value_row(f.v)) for f in command.facts], T.StructType([SCHEMA["e"], SCHEMA["a"], SCHEMA["v"]]))
            triples = triples.withColumn("vkey", identity()).select("e", "a", "vkey").distinct()
            held = windows.where((F.col("valid_from") <= at) & (F.col("valid_to") > at)).join(triples, ["e", "a", "vkey"], "left_semi")
            held = written(held.select("e", "a", "v", "vkey", "valid_from", "valid_to"), "forgotten")
            n = held.select("e", "a", "vkey").distinct().count()
            if not n:
                return Receipt("forgotten", None, head, 0)
            tx, ms = self._next()
            stamp = {"tx_id": F.lit(ms), "tx_count": F.lit(tx)}
            closed = held.withColumns(stamp | {"asserted": F.lit(False)})
            left = held.where(F.col("valid_from") < at).dropDuplicates(["e", "a", "vkey", "valid_from"]).withColumns(stamp | {"asserted": F.lit(True), "valid_to": F.lit(at)})
            both = closed.unionByName(left).withColumn("seq", F.monotonically_increasing_id())
            self._log().append_frame(both.select(*(F.col(f.name).cast(f.dataType) for f in SCHEMA.fields)), tx)
            return Receipt("forgotten", ms, tx, n)

    def compact(self, partitions: int = 8) -> bool:
        """Rewrite a folder's commits as one, sorted for scans by attribute and entity; whether there was anything to do."""
        return self._log().compact(partitions) if isinstance(self.log, ParquetLog) else False

    def vacuum(self) -> int:
        """Delete what compaction covered, when no older reader or stream runs; how many folders went."""
        return self._log().vacuum() if isinstance(self.log, ParquetLog) else 0

    def backup(self, path: str) -> int:
        """Copy the committed log to a fresh folder; the last transaction that it holds."""
        if not isinstance(self.log, ParquetLog):
            raise DatalogError("only a log in a folder can be backed up")
        with self._lock:
            return self.log.backup(path)

    # --- functions of users ----------------------------------------------------------------------------------------

    def register_aggregate(self, name: str, aggregate: UserAggregate) -> None:
        if name in AGGREGATES | WINDOWS or name in self.aggregates:
            raise DatalogError(f"{name} is taken")
        self.aggregates[name] = aggregate

    def register_predicate(self, name: str, predicate: Callable[[Column], Column]) -> None:
        """A test from Column to boolean Column: built-in functions, or a pandas UDF."""
        if name in BINARY | TYPE_TESTS or name in self.predicates:
            raise DatalogError(f"{name} is taken")
        self.predicates[name] = predicate

    def _log(self) -> MemoryLog | ParquetLog:
        if self.log is None:
            raise DatalogError("this engine has no fact log")
        return self.log

    def _next(self) -> tuple[int, int]:
        return self._log().head + 1, self.clock()


def _entity(c: Const) -> str:
    return entity_id(c.value) if c.kind == "kw" else c.value


def _as_struct(field: T.StructField) -> Column:
    """A result column as a value struct."""
    kind = {"bigint": "int", "double": "float", "boolean": "bool", "string": "string"}.get(field.dataType.simpleString(), "any")
    return boxed(Val(kind, F.col(field.name)))


def stamped(rows: Sequence[tuple[type, ast.Fact]], tx: int, ms: int) -> list[tuple]:
    """Log rows of facts to be asserted (Transact) or retracted (Retract) in one transaction; equal rows once."""
    out = []
    for kind, f in rows:
        put = kind is ast.Transact
        if not put and f.valid_from is None and f.valid_to is None:
            window = (ALL_TIME, FOREVER)
        else:
            window = (millis(f.valid_from) if f.valid_from else ms, millis(f.valid_to) if f.valid_to else FOREVER)
        if window[0] >= window[1]:
            raise DatalogError(f"valid time ends before it begins: {text_of(window[0])}")
        out.append((_entity(f.e), f.a, value_row(f.v), ms, tx, *window, put))
    return [(*r, k) for k, r in enumerate(dict.fromkeys(out))]


class WriteTransaction:
    """Staged writes: queries inside see them, commit publishes all under one number, leaving with an error drops them."""

    def __init__(self, engine: Engine):
        self.engine, self.rows, self.open = engine, [], True
        self.receipt: Receipt | None = None

    def __enter__(self) -> WriteTransaction:
        self.engine._lock.acquire()
        return self

    def __exit__(self, kind, *_) -> None:
        try:
            if self.open:
                self.commit() if kind is None else self.rollback()
        finally:
            self.engine._lock.release()

    def execute(self, text: str) -> DataFrame | Receipt:
        if not self.open:
            raise DatalogError("the transaction has ended")
        command = parse(text)
        if isinstance(command, ast.Forget):
            raise DatalogError("forget can't be staged")
        if isinstance(command, ast.Rule):
            return self.engine.add_rule(command)
        if isinstance(command, ast.Query):
            log = self.engine._log()
            ms = self.engine.clock()
            staged = []
            for k, row in enumerate(self.rows):  # each staged write counts as later than the one before
                staged += stamped([row], log.head + 1 + k, ms)
            return self.engine.run_query(command, log.read().unionByName(self.engine.spark.createDataFrame(staged, SCHEMA)), floor=ms)
        self.rows += [(type(command), f) for f in command.facts]
        return Receipt("ok")

    def commit(self) -> Receipt:
        if not self.open:
            raise DatalogError("the transaction has ended")
        self.open = False
        tx, ms = self.engine._next()
        self.engine._log().append(stamped(self.rows, tx, ms), tx)
        self.receipt = Receipt("transacted", ms, tx, len(self.rows))
        return self.receipt

    def rollback(self) -> None:
        self.open, self.rows = False, []


class Prepared:
    """A parsed query with slots."""

    def __init__(self, engine: Engine, query: ast.Query):
        self.engine, self.query = engine, query
        self.slots = sorted(_slots(query))

    def execute(self, **values: object) -> DataFrame:
        """Run with a value for each slot: plain Python values, ("kw"|"ref", text), Const, or ANY_TIME as a valid time."""
        if missing := [s for s in self.slots if s not in values]:
            raise DatalogError(f"no value for ${missing[0]}")
        return self.engine.run_query(_filled(self.query, values))


def _slots(form: object) -> set[str]:
    if isinstance(form, Slot):
        return {form.name}
    if isinstance(form, (tuple, list)):
        return set().union(*map(_slots, form)) if form else set()
    return set().union(*(_slots(getattr(form, f.name)) for f in fields(form))) if is_dataclass(form) and fields(form) else set()


def constant(value: object) -> Const:
    """A Python value as a literal."""
    if isinstance(value, Const):
        return value
    if isinstance(value, tuple) and len(value) == 2 and value[0] in ("kw", "ref"):
        return Const(*value)
    for kind, of in (("bool", bool), ("int", int), ("float", float), ("string", str)):
        if isinstance(value, of):
            return Const(kind, value)
    if value is None:
        return Const("nil", None)
    raise DatalogError(f"{value!r} can't be a value")


def _filled(form: object, values: dict[str, object]) -> object:
    if isinstance(form, ast.Query):
        made = {f.name: _filled(getattr(form, f.name), values) for f in fields(form) if f.name not in ("as_of", "valid_at")}
        as_of, valid_at, anytime = (values[x.name] if isinstance(x, Slot) else x for x in (form.as_of, form.valid_at, form.any_valid_time))
        if isinstance(valid_at, AnyTime):
            valid_at, anytime = None, True
        if as_of is not None and (isinstance(as_of, bool) or not isinstance(as_of, (int, str))) or valid_at is not None and (isinstance(valid_at, bool) or not isinstance(valid_at, (int, str))):
            raise DatalogError("a slot has a value of a wrong kind")
        return ast.Query(**made | {"as_of": as_of, "valid_at": valid_at, "any_valid_time": anytime})
    if isinstance(form, ast.Pattern):
        e = _filled(form.e, values)
        if isinstance(form.e, Slot) and e.kind not in ("kw", "ref"):
            raise DatalogError("an entity is a keyword or a uuid")
        return ast.Pattern(e, form.a, _filled(form.v, values))
    if isinstance(form, Slot):
        return constant(values[form.name])
    if isinstance(form, tuple):
        return tuple(_filled(f, values) for f in form)
    if is_dataclass(form) and not isinstance(form, (Var, Const)):
        return type(form)(**{f.name: _filled(getattr(form, f.name), values) for f in fields(form)})
    return form


def _cursor(kind: str, place: list) -> str:
    body = json.dumps([1, kind, place], separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(body + zlib.crc32(body).to_bytes(4, "big")).decode()


def _place(kind: str, cursor: str) -> list:
    try:
        raw = base64.urlsafe_b64decode(cursor)
        version, own, place = json.loads(raw[:-4])
        if zlib.crc32(raw[:-4]).to_bytes(4, "big") != raw[-4:] or (version, own) != (1, kind):
            raise ValueError
    except ValueError:
        raise DatalogError("the cursor is damaged or of another reader") from None
    return place


def _later(key: list[str], place: list) -> Column:
    """Rows behind a place in the order of a key."""
    out, equal = F.lit(False), F.lit(True)
    for k, v in zip(key, place, strict=True):
        out, equal = out | (equal & (F.col(k) > v)), equal & (F.col(k) == v)
    return out


@dataclass(frozen=True)
class Page:
    """Rows of a paged reader, and where the next page begins."""

    rows: list
    cursor: str | None


class ReadView:
    """A state of the log, fixed when it was opened: bounded readers that refuse what exceeds their limit."""

    def __init__(self, engine: Engine, tx_count: int, instant: int | None):
        self.engine, self.tx_count, self.instant = engine, tx_count, instant
        self.log = engine._log().read()

    def _windows(self, attributes: Sequence[str], instant: int | None) -> DataFrame:
        df = temporal.net_windows(temporal.as_of(self.log.where(F.col("a").isin(*attributes)), self.tx_count))
        return df if instant is None else temporal.valid_at(df, instant)

    @staticmethod
    def _bounded(df: DataFrame, limit: int) -> list:
        if not 0 < limit <= 10_000:
            raise DatalogError("a limit is 1 to 10,000")
        rows = df.limit(limit + 1).collect()
        if len(rows) > limit:
            raise DatalogError(f"more than {limit} rows")
        return rows

    def query(self, text: str, limit: int) -> list:
        """Rows of a query that sets no times or limits of its own."""
        q = parse(text)
        if not isinstance(q, ast.Query) or q.as_of is not None or q.valid_at is not None or q.any_valid_time or q.max_results is not None:
            raise DatalogError("a view takes a query without times or limits")
        q = replace(q, as_of=self.tx_count, any_valid_time=self.instant is None)
        return self._bounded(self.engine.run_query(q, self.log, self.instant), limit)

    def current_entities(self, entities: Sequence[str], attributes: Sequence[str], limit: int = 10_000) -> list:
        """Values of entities (uuids or keywords) x attributes, in the order asked for."""
        if len(entities) > 128 or len(attributes) > 32 or len(entities) * len(attributes) > 256:
            raise DatalogError("at most 128 entities, 32 attributes and 256 pairs")
        ids = [entity_id(e) if e.startswith(":") else e for e in entities]
        found = self._windows(attributes, self.instant).where(F.col("e").isin(*ids))
        rows = self._bounded(found.select("e", "a", "v", "valid_from", "valid_to", "tx_count"), limit)
        return sorted(rows, key=lambda r: (ids.index(r.e), list(attributes).index(r.a), str(r.v), r.valid_from))

    def refs_to(self, attribute: str, target: str, limit: int) -> list[str]:
        """Entities whose attribute refers to a target, once each, in order."""
        to = entity_id(target) if target.startswith(":") else target
        found = self._windows([attribute], self.instant).where((F.col("v.t") == TAGS["ref"]) & (F.col("v.s") == to))
        return [r.e for r in self._bounded(found.select("e").distinct().orderBy("e"), limit)]

    def entity_attribute_history(self, entity: str, attribute: str, limit: int, after: str | None = None) -> Page:
        """All records of an entity's attribute, assertions and retractions, page by page."""
        if self.instant is not None:
            raise DatalogError("history needs a view of any valid time")
        e = entity_id(entity) if entity.startswith(":") else entity
        df = temporal.as_of(self.log.where((F.col("a") == attribute) & (F.col("e") == e)), self.tx_count).withColumn("vkey", identity())
        key = ["vkey", "valid_from", "valid_to", "tx_count", "seq"]
        if after:
            df = df.where(_later(key, _place("history", after)))
        rows = df.orderBy(*key).limit(limit + 1).collect()
        more = len(rows) > limit
        return Page(rows[:limit], _cursor("history", [rows[limit - 1][k] for k in key]) if more else None)

    def diff_frame(self, attribute: str, before: int | str, after: int | str, entities: Sequence[str] | None = None) -> DataFrame:
        """e, v, change ('appeared' or 'disappeared') and the covering window of values that differ between two valid times."""
        t1, t2 = (millis(t) if isinstance(t, str) else t for t in (before, after))
        windows = self._windows([attribute], None)
        if entities is not None:
            windows = windows.where(F.col("e").isin(*(entity_id(e) if e.startswith(":") else e for e in entities)))
        windows = windows.where(((F.col("valid_from") <= t1) & (F.col("valid_to") > t1)) | ((F.col("valid_from") <= t2) & (F.col("valid_to") > t2)))
        held = lambda t: F.max(F.when((F.col("valid_from") <= t) & (F.col("valid_to") > t), F.struct("tx_count", "valid_from", "valid_to", "v")))
        both = windows.groupBy("e", "vkey").agg(held(t1).alias("old"), held(t2).alias("new")).where(F.col("old").isNull() != F.col("new").isNull())
        side = F.coalesce("new", "old")
        return both.select("e", side["v"].alias("v"), F.when(F.col("old").isNull(), "appeared").otherwise("disappeared").alias("change"), side["valid_from"].alias("valid_from"), side["valid_to"].alias("valid_to"), "vkey")

    def valid_time_diff(self, attribute: str, before: int | str, after: int | str, limit: int, entities: Sequence[str] | None = None, cursor: str | None = None) -> Page:
        """diff_frame() page by page, whole entities at a time."""
        df = self.diff_frame(attribute, before, after, entities)
        if cursor:
            df = df.where(F.col("e") > _place("diff", cursor)[0])
        rows = df.orderBy("e", "vkey").limit(limit + 1).collect()
        if len(rows) <= limit:
            return Page(rows, None)
        whole = [r for r in rows if r.e != rows[-1].e]
        if not whole:
            raise DatalogError(f"one entity has more than {limit} changes")
        return Page(whole, _cursor("diff", [whole[-1].e]))

    def current_value(self, entity: str, attribute: str) -> object:
        """The newest standing value of an entity's attribute, or None."""
        e = entity_id(entity) if entity.startswith(":") else entity
        row = self._windows([attribute], self.instant).where(F.col("e") == e).agg(F.max_by("v", "tx_count").alias("v")).first()
        return row.v
