"""The fact log in time: as-of, valid time, retraction, forget, views, transactions, folders, streams."""

import pytest
from pyspark.sql import functions as F

from test_engine import rows
from tidemark.engine import ANY_TIME, Engine
from tidemark.functions.edn import DatalogError
from tidemark.functions.times import FOREVER, millis
from tidemark.functions.values import entity_id
from tidemark.streaming import changes


class Clock:
    def __init__(self, now):
        self.now = now

    def __call__(self):
        self.now += 1
        return self.now


@pytest.fixture
def engine(spark):
    return Engine.memory(spark, clock=Clock(millis("2026-01-01")))


def count(engine, extra=""):
    return rows(engine.query(f"(query [:find (count ?v) {extra} :where [?e :s ?v]])"))[0][0]


def test_as_of_and_retraction(engine):
    engine.execute("(transact [[:a :s 1]])")
    engine.execute("(transact [[:a :s 2] [:b :s 2]])")
    engine.execute("(retract [[:a :s 1]])")
    assert [count(engine, f":as-of {n} :any-valid-time") for n in (0, 1, 2, 3)] == [0, 1, 3, 2]
    assert count(engine) == 2
    engine.execute("(transact [[:a :s 1]])")
    assert count(engine) == 3


def test_windows(engine):
    engine.execute('(transact {:valid-from "2020-01-01" :valid-to "2090-01-01"} [[:c :s 7]])')
    engine.execute('(transact {:valid-from "2025-01-01" :valid-to "2100-01-01"} [[:c :s 7]])')
    assert count(engine) == 1 and count(engine, ":any-valid-time") == 2
    assert count(engine, ':valid-at "2095-01-01"') == 1 and count(engine, ':valid-at "2100-01-01"') == 0
    engine.execute('(retract [[:c :s 7 {:valid-from "2025-01-01" :valid-to "2100-01-01"}]])')
    assert count(engine, ":any-valid-time") == 1
    engine.execute("(retract [[:c :s 7]])")
    assert count(engine, ":any-valid-time") == 0


def test_metadata(engine):
    engine.execute('(transact {:valid-from "2020-01-01" :valid-to "2021-01-01"} [[:c :s 7]])')
    got = rows(engine.query("(query [:find ?v ?f ?t ?c :any-valid-time :where [?e :s ?v] [?e :db/valid-from ?f] [?e :db/valid-to ?t] [?e :db/tx-count ?c]])"))
    assert got == [(7, millis("2020-01-01"), millis("2021-01-01"), 1)]
    assert rows(engine.query('(query [:find ?v ?at :valid-at "2020-06-01" :where [?e :s ?v] [?e :db/valid-at ?at]])')) == [(7, millis("2020-06-01"))]
    with pytest.raises(DatalogError):
        engine.query("(query [:find ?f :where [?e :s ?v] [?e :db/valid-from ?f]])")


def test_forget(engine):
    engine.execute('(transact {:valid-from "2026-01-01"} [[:a :s :on] [:b :s :on] [:c :s :off]])')
    got = engine.execute('(forget {:valid-to "2026-07-01"} [:find ?e ?a ?v :where [?e :s :on] [?e ?a ?v]])')
    assert (got.kind, got.count, got.tx_count) == ("forgotten", 2, 2)
    assert count(engine, ':valid-at "2026-06-30"') == 3 and count(engine, ':valid-at "2026-07-01"') == 1
    assert count(engine, ':as-of 1 :valid-at "2026-07-01"') == 3
    again = engine.execute('(forget {:valid-to "2026-07-01"} [[:a :s :on]])')
    assert (again.tx_id, again.count, engine.log.head) == (None, 0, 2)
    engine.execute('(forget {:valid-to "2026-01-01"} [[:c :s :off]])')
    assert count(engine, ":any-valid-time") == 2


def test_transactions(engine):
    with engine.begin() as tx:
        tx.execute("(transact [[:a :s 1]])")
        tx.execute("(retract [[:a :s 1]])")
        tx.execute("(transact [[:b :s 2]])")
        assert rows(tx.execute("(query [:find ?v :where [?e :s ?v]])")) == [(2,)]
    assert engine.log.head == 1 and count(engine) == 1
    with pytest.raises(RuntimeError):
        with engine.begin() as tx:
            tx.execute("(transact [[:z :s 1]])")
            raise RuntimeError
    assert engine.log.head == 1
    assert engine.batch(["(transact [[:a :s 3]])", "(transact [[:a :s 4]])"]).tx_count == 2


def test_views(engine):
    engine.execute('(transact {:valid-from "2020-01-01" :valid-to "2022-01-01"} [[:a :s :old] [:b :s :old]])')
    engine.execute(f'(transact {{:valid-from "2022-01-01"}} [[:a :s :new] [:a :to #uuid "{entity_id(":t")}"]])')
    view = engine.read_view()
    engine.execute("(retract [[:a :s :new]])")
    assert [r.v.s for r in view.current_entities([":b", ":a"], [":s"])] == [":new"]
    assert view.refs_to(":to", ":t", 5) == [entity_id(":a")]
    assert len(view.query("(query [:find ?v :where [?e :s ?v]])", 5)) == 1
    assert view.current_value(":a", ":s").s == ":new"
    diff = view.valid_time_diff(":s", "2021-01-01", "2023-01-01", 10)
    assert sorted((r.v.s, r.change) for r in diff.rows) == [(":new", "appeared"), (":old", "disappeared"), (":old", "disappeared")]
    first = view.valid_time_diff(":s", "2021-01-01", "2023-01-01", 2)
    second = view.valid_time_diff(":s", "2021-01-01", "2023-01-01", 2, cursor=first.cursor)
    assert len(first.rows) + len(second.rows) == 3 and second.cursor is None
    history = engine.read_view(valid_at=ANY_TIME)
    page = history.entity_attribute_history(":a", ":s", 2)
    rest = history.entity_attribute_history(":a", ":s", 2, page.cursor)
    assert [r.asserted for r in [*page.rows, *rest.rows]].count(False) == 1 and len(page.rows) + len(rest.rows) == 3
    for wrong in (lambda: view.query("(query [:find ?v :as-of 1 :where [?e :s ?v]])", 5), lambda: view.entity_attribute_history(":a", ":s", 1), lambda: engine.read_view(as_of=99), lambda: view.valid_time_diff(":s", 0, 1, 1, cursor="x")):
        with pytest.raises(DatalogError):
            wrong()


def test_prepared(engine):
    engine.execute("(transact [[:a :s 1] [:b :s 2]])")
    p = engine.prepare("(query [:find ?e :as-of $n :valid-at $t :where [?e :s $v]])")
    assert rows(p.execute(n=1, t=ANY_TIME, v=2)) == [(entity_id(":b"),)]
    with pytest.raises(DatalogError):
        p.execute(n=1, v=2)
    with pytest.raises(DatalogError):
        p.execute(n=1.5, t=ANY_TIME, v=2)


def test_folder(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    engine = Engine.open(spark, path)
    engine.execute("(transact [[:a :s 1] [:b :s 2.5]])")
    engine.execute("(retract [[:a :s 1]])")
    other = Engine.open(spark, path)
    assert other.log.head == 2 and count(other) == 1
    engine.execute("(transact [[:c :s nil]])")
    with pytest.raises(ValueError):
        other.execute("(transact [[:d :s 1]])")  # it was opened before that write
    before = [tuple(r) for r in engine.export_fact_log().collect()]
    assert engine.compact() and not engine.compact()
    assert [tuple(r) for r in engine.export_fact_log().collect()] == before and len(engine.log._ranges()) == 1
    assert [r.tx_count for r in engine.export_fact_log_since(2).collect()] == [3]
    assert engine.backup(f"file://{tmp_path}/copy") == 3
    assert [tuple(r) for r in Engine.open(spark, f"file://{tmp_path}/copy").export_fact_log().collect()] == before
    with pytest.raises(FileExistsError):
        engine.backup(f"file://{tmp_path}/copy")


def test_stream(spark, tmp_path):
    path, target = f"file://{tmp_path}/log", f"file://{tmp_path}/current"
    engine = Engine.open(spark, path)
    engine.execute("(transact [[:a :s 1] [:b :s 2]])")
    changes.keep_current(spark, path, f"file://{tmp_path}/cp", target).awaitTermination()
    engine.execute("(retract [[:a :s 1]])")
    engine.execute("(transact [[:b :s 3]])")
    changes.keep_current(spark, path, f"file://{tmp_path}/cp", target).awaitTermination()
    got = sorted((r.v.i, r.valid_to) for r in changes.current(spark, target).collect())
    assert got == [(2, FOREVER), (3, FOREVER)]


def test_two_writers_of_a_folder(spark, tmp_path):
    """The one that loses sees the other's commit, and its next try wins; a claim of a writer that died is given away."""
    path = f"file://{tmp_path}/log"
    one, two = Engine.open(spark, path), Engine.open(spark, path)
    one.execute("(transact [[:a :s 1]])")
    with pytest.raises(ValueError):
        two.execute("(transact [[:b :s 2]])")
    two.execute("(transact [[:b :s 2]])")
    with pytest.raises(ValueError):
        one.execute("(transact [[:c :s 3]])")
    (tmp_path / "log" / "claims" / "3").touch()  # its writer never came to publish
    with pytest.raises(ValueError):
        one.execute("(transact [[:c :s 3]])")
    one.log.STALE_MS = -1
    one.execute("(transact [[:c :s 3]])")
    assert count(Engine.open(spark, path)) == 3


def test_readers_and_streams_survive_compaction(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    engine = Engine.open(spark, path)
    for k in range(3):
        engine.execute(f"(transact [[:a{k} :s {k}]])")
    seen = []
    follow = lambda: changes.each_batch(changes.tail(spark, path), f"file://{tmp_path}/cp", lambda df, n: seen.extend(r.tx_count for r in df.collect())).awaitTermination()
    follow()
    view = engine.read_view()
    early = engine.query("(query [:find ?v :where [?e :s ?v]])")
    assert engine.compact()
    assert early.count() == 3 and len(view.query("(query [:find ?v :where [?e :s ?v]])", 10)) == 3
    follow()
    engine.execute("(transact [[:a3 :s 3]])")
    follow()
    assert sorted(seen) == [1, 2, 3, 4]
    assert engine.compact() and engine.vacuum() == 5 and count(Engine.open(spark, path)) == 4


def test_exports_have_one_order(spark, tmp_path):
    engine = Engine.open(spark, f"file://{tmp_path}/log", clock=lambda: 1000)
    value = F.struct(F.lit(2).cast("byte").alias("t"), F.col("id").alias("i"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("string").alias("s"))
    engine.load(spark.range(50).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("e"), F.lit(":n").alias("a"), value.alias("v"), F.lit(0).alias("valid_from")))
    done = engine.execute('(forget {:valid-to "1970-01-01T00:00:00.500Z"} [:find ?e ?a ?v :where [?e ?a ?v] [?e :n ?v]])')
    log = engine.export_fact_log().collect()
    assert len({(r.tx_count, r.seq) for r in log}) == len(log) == 150 and done.count == 50
    assert engine.query('(query [:find (count ?v) :any-valid-time :where [?e :n ?v] [?e :db/valid-to ?t] [(= ?t 500)]])').first()[0] == 50


def test_time_queries_deal_records_once(spark, folder):
    """Two patterns over a log: one exchange for each reduction, at most one for the join of both, and one for the count."""
    from tidemark import catalogue

    df = catalogue.QUERIES["any_valid"](spark, folder)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortAggregate" not in plan and plan.count("Exchange hashpartitioning") <= 4
