"""The engine over a fact log: joins, negation, disjunction, aggregates, windows, rules, against small scenarios and a naive evaluator."""

import random
from collections import Counter

import pytest

from naive import evaluate, fixpoint
from tidemark.engine import Engine
from tidemark.functions.edn import DatalogError
from tidemark.functions.values import entity_id, unboxed
from tidemark.operators.results import UserAggregate
from tidemark.plans.parser import parse


def rows(df):
    """Result rows as plain tuples, in any order."""
    plain = lambda x: unboxed(x) if hasattr(x, "asDict") else x
    return sorted((tuple(plain(x) for x in r) for r in df.collect()), key=repr)


@pytest.fixture
def engine(spark):
    made = Engine.memory(spark)
    made.execute('(transact [[:alice :name "Alice"] [:alice :friend :bob] [:alice :age 30] [:bob :name "Bob"] [:bob :friend :carol] [:bob :age 25] [:carol :name "Carol"] [:carol :age 35] [:carol :friend :alice] [:carol :banned true]])')
    return made


def test_joins(engine):
    assert rows(engine.query("(query [:find ?n ?m :where [?a :friend ?b] [?a :name ?n] [?b :name ?m]])")) == [("Alice", "Bob"), ("Bob", "Carol"), ("Carol", "Alice")]
    assert rows(engine.query("(query [:find ?n :where [?a :friend :carol] [?a :name ?n]])")) == [("Bob",)]
    assert rows(engine.query("(query [:find ?a :where [:alice ?a 30]])")) == [(":age",)]
    assert rows(engine.query("(query [:find ?e :where [?e :age 25]])")) == [(entity_id(":bob"),)]
    assert len(rows(engine.query("(query [:find ?n ?k :where [?a :name ?n] [?b :age ?k]])"))) == 9


def test_negation_and_disjunction(engine):
    assert rows(engine.query("(query [:find ?n :where [?a :name ?n] (not [?a :banned true])])")) == [("Alice",), ("Bob",)]
    assert rows(engine.query("(query [:find ?n :where [?a :name ?n] (not-join [?a] [?a :friend ?b] [?b :banned true])])")) == [("Alice",), ("Carol",)]
    assert rows(engine.query("(query [:find ?n :where [?a :name ?n] [?a :age ?k] (not [(> ?k 28)])])")) == [("Bob",)]
    assert rows(engine.query("(query [:find ?n :where [?a :name ?n] (or [?a :banned true] [?a :age 25])])")) == [("Bob",), ("Carol",)]
    assert rows(engine.query("(query [:find ?n :where [?a :name ?n] [?a :age ?k] (or (and [(> ?k 33)] [?a :name ?n]) [?a :age 25])])")) == [("Bob",), ("Carol",)]
    assert rows(engine.query("(query [:find ?n :where [?a :name ?n] (or-join [?a] [?b :friend ?a] [?a :age 1])])")) == [("Alice",), ("Bob",), ("Carol",)]
    assert rows(engine.query('(query [:find ?n :where [?a :name ?n] (not-join [?n] [?x :name ?n] [(= ?n "Bob")])])')) == [("Alice",), ("Carol",)]


def test_values(spark):
    e = Engine.memory(spark)
    e.execute('(transact [[:a :v 10] [:b :v 0.5] [:c :w "x"] [:d :w true] [:f :n nil] [:g :n 1] [:h :z 1] [:h :z 1.0] [:i :u 9223372036854775807]])')
    assert rows(e.query("(query [:find (sum ?x) :where [?e :v ?x]])")) == [(10.5,)]
    assert rows(e.query("(query [:find (count ?x) :where [?e :n ?x]])")) == [(1,)]
    assert rows(e.query("(query [:find (sum ?x) :where [?e :n ?x]])")) == [(1,)]
    assert rows(e.query("(query [:find (sum ?x) :where [?e :none ?x]])")) == []
    assert rows(e.query("(query [:find (count ?x) :where [?e :none ?x]])")) == [(0,)]
    assert rows(e.query("(query [:find (count-distinct ?x) :where [?e :z ?x]])")) == [(2,)]
    assert rows(e.query("(query [:find ?y :where [?e :u ?x] [(+ ?x 1) ?y]])")) == [(-(1 << 63),)]
    assert rows(e.query("(query [:find ?x :where [?e :n ?x] [(nil? ?x)]])")) == [(None,)]
    assert rows(e.query("(query [:find ?e :where [?e :n nil]])")) == [(entity_id(":f"),)]
    for bad in ("(query [:find (sum ?x) :where [?e :w ?x]])", "(query [:find (min ?x) :where [?e :z ?x]])", "(query [:find (max ?x) :where [?e :w ?x]])"):
        with pytest.raises(Exception):  # noqa: B017
            e.query(bad).collect()
    for bad in ("(query [:find (nosuch ?x) :where [?e :v ?x]])", "(query [:find ?x :where [?e :v ?x] [(nosuch? ?x)]])", "(query [:find ?x :where [?e :v $x]])"):
        with pytest.raises(DatalogError):
            e.query(bad)


def test_windows_and_aggregates(spark):
    e = Engine.memory(spark)
    e.execute('(transact [[:a :s 10] [:b :s 10] [:c :s 20] [:a :d "x"] [:b :d "x"] [:c :d "y"] [:a :k 1] [:b :k 2] [:c :k 3]])')
    assert rows(e.query("(query [:find ?s (rank :over (:order-by ?s)) :where [?e :s ?s]])")) == [(10, 1), (10, 1), (20, 3)]
    assert rows(e.query("(query [:find ?k (sum ?s :over (:order-by ?k)) (avg ?s :over (:partition-by ?d :order-by ?k)) :where [?e :s ?s] [?e :k ?k] [?e :d ?d]])")) == [(1, 10, 10.0), (2, 20, 10.0), (3, 40, 20.0)]
    assert rows(e.query("(query [:find ?d (sum ?s) :where [?e :s ?s] [?e :d ?d]])")) == [("x", 20), ("y", 20)]
    assert rows(e.query("(query [:find ?d (sum ?s) :with ?e :where [?e :s ?s] [?e :d ?d]])")) == [("x", 10), ("x", 10), ("y", 20)]
    assert rows(e.query("(query [:find ?d (count ?e) (rank :over (:order-by ?d)) :where [?e :d ?d]])")) == [("x", 2, 1), ("y", 1, 2)]


def test_user_functions(spark):
    e = Engine.memory(spark)
    e.execute("(transact [[:a :s 2] [:b :s 8] [:c :s nil]])")
    e.register_aggregate("geomean", UserAggregate(lambda: 1.0, lambda a, x: a * x, lambda a, n: a ** (1 / n)))
    e.register_predicate("even?", lambda c: c["i"] % 4 == 0)
    assert rows(e.query("(query [:find (geomean ?s) :where [?e :s ?s]])")) == [(4.0,)]
    assert rows(e.query("(query [:find ?s :where [?e :s ?s] [(even? ?s)]])")) == [(8,)]
    with pytest.raises(DatalogError):
        e.register_aggregate("sum", UserAggregate(int, max, max))


def test_rules(engine):
    engine.execute("(rule [(reach ?x ?y) [?x :friend ?y]])")
    engine.execute("(rule [(reach ?x ?y) [?x :friend ?m] (reach ?m ?y)])")
    assert len(rows(engine.query("(query [:find ?x ?y :where (reach ?x ?y)])"))) == 9
    assert rows(engine.query("(query [:find ?n :where (reach :alice ?y) [?y :name ?n]])")) == [("Alice",), ("Bob",), ("Carol",)]
    assert rows(engine.query("(query [:find ?n :where (reach ?x :bob) [?x :name ?n]])")) == [("Alice",), ("Bob",), ("Carol",)]
    engine.execute("(rule [(fine ?x) [?x :name ?n] (not [?x :banned true])])")
    assert rows(engine.query("(query [:find ?n :where (fine ?x) [?x :name ?n]])")) == [("Alice",), ("Bob",)]
    with pytest.raises(DatalogError):
        engine.execute("(rule [(odd ?x) [?x :name ?n] (not (odd ?x))])")
    with pytest.raises(DatalogError):
        engine.query("(query [:find ?x ?y :max-results 3 :where (reach ?x ?y)])")


QUERIES = [
    "(query [:find ?x ?y :where [?x :p ?y] [?y :p ?x]])",
    "(query [:find ?x ?z :where [?x :p ?y] [?y :q ?z] (not [?x :q ?z])])",
    "(query [:find ?x :where [?x :p ?y] (not-join [?x] [?x :q ?z] [?z :p ?w])])",
    "(query [:find ?x ?y :where [?x :p ?y] (or [?x :q ?y] [?y :q ?x])])",
    "(query [:find ?x ?z :where [?x :p _] (or [?x :q ?z] (and [?z :q ?x] [?z :p _]))])",
    "(query [:find ?x :where [?x :n ?k] (or-join [?x] [?x :p ?y] (and [?x :q ?z] [?z :n ?j]))])",
    "(query [:find ?x ?s :where [?x :n ?k] [?x :p ?y] [?y :n ?j] [(+ ?k ?j) ?s] [(> ?s 4)]])",
    "(query [:find ?k :where [?x :n ?k] (not [?x :p ?x])])",
    "(query [:find ?x ?y :where (far ?x ?y) (not [?x :p ?y])])",
    "(query [:find ?x ?y :where (even ?x ?y)])",
]
RULES = [
    "(rule [(far ?x ?y) [?x :p ?y]])", "(rule [(far ?x ?y) [?x :p ?m] (far ?m ?y)])", "(rule [(odd ?x ?y) [?x :q ?y]])",
    "(rule [(odd ?x ?y) (even ?x ?m) [?m :q ?y]])", "(rule [(even ?x ?y) (odd ?x ?m) [?m :q ?y]])",
]


@pytest.mark.parametrize("seed", range(3))
def test_against_naive_evaluator(spark, seed):
    rng = random.Random(seed)
    names = {f":n{k}": entity_id(f":n{k}") for k in range(6)}
    facts = {(rng.choice(list(names)), rng.choice([":p", ":q"]), rng.choice(list(names))) for _ in range(14)}
    numbers = {(n, ":n", rng.randrange(5)) for n in names}
    engine = Engine.memory(spark)
    engine.execute("(transact [" + " ".join(f'[{e} {a} #uuid "{names[v]}"]' for e, a, v in sorted(facts)) + " ".join(f"[{e} {a} {v}]" for e, a, v in sorted(numbers)) + "])")
    for r in RULES:
        engine.execute(r)
    plain = [(names[e], a, names.get(v, v)) for e, a, v in facts | numbers]
    derived = fixpoint([parse(r) for r in RULES], plain)
    for text in QUERIES:
        q = parse(text)
        want = Counter(tuple(b[v] for v in q.find) for b in evaluate(q.where, plain, [{}], derived))
        got = Counter(tuple(x[1] if isinstance(x, tuple) else x for x in r) for r in rows(engine.run_query(q)))
        assert got == want, text
