"""Counts over recursive relations, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark import catalogue
from tidemark.engine import Engine
from tidemark.operators import counts
from tidemark.sources.relations import Attribute, Relation

LATER = ("(later ?x ?y) [?x :node/next ?y]", "(later ?x ?y) (later ?x ?m) [?m :node/next ?y]")
SAME = ("(same ?x ?y) [?x :node/next ?p] [?y :node/next ?p]", "(same ?x ?y) [?y :node/next ?b] [?x :node/next ?a] (same ?a ?b)")
BACK = ("(step ?p ?x) [?x :node/next ?p]", "(same ?x ?y) (step ?p ?x) (step ?p ?y)", "(same ?x ?y) (step ?a ?x) (same ?a ?b) (step ?b ?y)")


def answers(spark, steps, rules, query):
    df = spark.createDataFrame(steps, "k long, y long")
    node = Relation("node", lambda: df, "k", {":node/next": Attribute("ent:node", F.col("y"))})
    engine = Engine(spark, [node])
    for r in rules:
        engine.execute(f"(rule [{r}])")
    return {r[0]: r[1] for r in engine.query(f"(query [{query}])").collect()}


def closure(steps):
    out = {s for s in steps if s[1] is not None}
    while new := {(a, d) for a, b in out for c, d in steps if b == c and d is not None} - out:
        out |= new
    return out


def generations(steps):
    live = [s for s in steps if s[1] is not None]
    out = {(a, b) for a, p in live for b, q in live if p == q}
    while new := {(a, b) for a, p in live for b, q in live if (p, q) in out} - out:
        out |= new
    return out


def counted(pairs, end):
    return {v: sum(p[end] == v for p in pairs) for v in {p[end] for p in pairs}}


def graphs():
    rng = random.Random(5)
    yield "cycles", [(k, rng.randrange(40)) for k in range(40)]
    yield "cycles and ends", [(k, rng.choice([None, *range(40)])) for k in range(30)]
    yield "forest", [(k, rng.randrange(k) if k % 9 else None) for k in range(40)]
    yield "one cycle, one loop, repeated rows", [(k, (k + 1) % 8) for k in range(8)] * 2 + [(9, 9), (10, 9), (11, 3)]
    yield "one step", [(1, 2)]
    yield "empty", []
    yield "two steps", [(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (5, 4), (6, 2), (6, 5)]


@pytest.mark.parametrize(("kind", "steps"), list(graphs()))
def test_counts_equal_brute_force(spark, kind, steps):
    assert answers(spark, steps, LATER, ":find ?x (count ?y) :where (later ?x ?y)") == counted(closure(steps), 0)
    assert answers(spark, steps, LATER, ":find ?y (count-distinct ?x) :where (later ?x ?y)") == counted(closure(steps), 1)
    assert answers(spark, steps, SAME, ":find ?x (count ?y) :where (same ?x ?y)") == counted(generations(steps), 0)
    assert answers(spark, steps, BACK, ":find ?y (count ?x) :where (same ?x ?y)") == counted(generations(steps), 0)


@pytest.mark.parametrize("last", ["(same ?x ?y) (step ?a ?x) (same ?a ?b) (step ?y ?b)", "(same ?x ?y) (step ?a ?x) (same ?b ?a) (step ?b ?y)", "(same ?x ?y) (step ?x ?a) (same ?a ?b) (step ?y ?b)"])
def test_other_rules_are_left_alone(spark, last):
    """Steps of mixed directions and ends the other way round: not the recognised rule, but for a symmetric relation equal where the ends only change places."""
    from tidemark.plans.parser import parse

    rules = [parse(f"(rule [{r}])") for r in (*BACK[1:2], last)]
    assert counts.generation_of(rules) is None


def test_many_parts_without_their_pairs(spark, tmp_path):
    """As many parts as in sf0.1, which make 200 million and 103 million pairs."""
    n = 20_000
    spark.range(1, n + 1).select(F.col("id").alias("p_partkey"), F.lit(1).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    chain = {r.x: r.n for r in catalogue.QUERIES["rule_chain"](spark, str(tmp_path)).collect()}
    assert chain == {k: n + 1 - k for k in range(1, n + 1)}
    same = {r.x: r.n for r in catalogue.QUERIES["rule_same_generation"](spark, str(tmp_path)).collect()}
    assert same == {k: min(n + 1, 1 << k.bit_length()) - (1 << k.bit_length() - 1) for k in range(2, n + 1)}
