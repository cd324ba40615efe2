"""Registered queries against their SQL on the smallest tables, and the plans that the design relies on."""

import os

import duckdb
import pandas as pd
import pytest

from tidemark import catalogue

SLOW = {"pattern_attr_var"}


@pytest.fixture(scope="module")
def sql():
    path = os.environ.get("TIDEMARK_TESTDATA", "/root/testdata/sf0.001")
    con = duckdb.connect()
    for file in os.listdir(path) if os.path.isdir(path) else ():
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{path}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equals_sql(spark, folder, sql, name):
    got, want = catalogue.QUERIES[name](spark, folder).toPandas(), sql.sql(catalogue.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    ordered = lambda df: df[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(ordered(got), ordered(want), check_dtype=False, rtol=1e-9)


@pytest.mark.parametrize(("name", "table", "least"), [("rule_same_generation", "part", 2), ("rule_chain", "part", 0), ("forget_facts", "events", 0)])
def test_whole_tables(spark, folder, name, table, least):
    """Every row of the table is in the result (the two keys without a parent, 0 and 1, have no generation)."""
    assert catalogue.QUERIES[name](spark, folder).count() == spark.read.parquet(f"{folder}/{table}.parquet").count() - least


def test_brute_force_on_parts(spark, tmp_path):
    spark.createDataFrame([(k, 1) for k in range(1, 331)], "p_partkey int, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    chain = {r.x: r.n for r in catalogue.QUERIES["rule_chain"](spark, str(tmp_path)).collect()}
    assert chain == {k: 331 - k for k in range(1, 331)}
    levels = [k.bit_length() for k in range(2, 331)]
    same = {r.x: r.n for r in catalogue.QUERIES["rule_same_generation"](spark, str(tmp_path)).collect()}
    assert same == {k: levels.count(k.bit_length()) for k in range(2, 331)}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_star_is_one_scan(spark, folder):
    plan = _plan(catalogue.QUERIES["join_star"](spark, folder))
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan
    assert "ReadSchema: struct<l_linenumber:int,l_quantity:double,l_extendedprice:double,l_returnflag:string>" in plan


def test_constants_reach_the_scan(spark, folder):
    assert "EqualTo(c_mktsegment,BUILDING)" in _plan(catalogue.QUERIES["pattern_const_str"](spark, folder))


def test_negation_is_an_anti_join(spark, folder):
    plan = _plan(catalogue.QUERIES["not_join"](spark, folder))
    assert "LeftAnti" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
