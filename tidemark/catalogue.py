"""The registered queries: Datalog over the tables of a data folder, each beside the SQL that gives the same rows."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .engine import ANY_TIME, Engine
from .functions.times import ALL_TIME, FOREVER
from .functions.values import struct, keyword_entity
from .operators.results import UserAggregate
from .plans.parser import parse
from .sources.log import SCHEMA, MemoryLog
from .sources.relations import Attribute, Relation, millis_of, star_schema
from .sources.scratch import shared_dir, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def relations(spark: SparkSession, folder: str) -> Engine:
    """An engine over the tables, with small graphs made from keys: a tree and chains of parts, a cyclic graph of nations."""
    part = lambda: spark.read.parquet(f"{folder}/part.parquet")
    key = F.col("p_partkey").cast("long")
    graphs = [
        Relation("tree", part, "p_partkey", {":tree/parent": Attribute("ent:tree", F.when(key > 1, F.floor(key / 2)).cast("long")), ":tree/size": Attribute("int", F.col("p_size").cast("long"))}),
        Relation("chain", part, "p_partkey", {":chain/next": Attribute("ent:chain", (key + 1).cast("long"))}),
        Relation("hop", lambda: spark.read.parquet(f"{folder}/nation.parquet"), "n_nationkey", {":hop/next": Attribute("ent:hop", ((F.col("n_nationkey") * 7 + 3) % 25).cast("long")), ":hop/number": Attribute("int", F.col("n_nationkey").cast("long")), ":hop/region": Attribute("int", F.col("n_regionkey").cast("long"))}),
    ]
    return Engine(spark, [*star_schema(spark, folder), *graphs])


TREE = "tree AS (SELECT p_partkey::BIGINT AS x, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END::BIGINT AS y FROM part)"
CHAIN = "chain AS (SELECT p_partkey::BIGINT AS x, (p_partkey + 1)::BIGINT AS y FROM part)"
HOP = "hop AS (SELECT n_nationkey::BIGINT AS x, ((n_nationkey * 7 + 3) % 25)::BIGINT AS y FROM nation)"
LIVE = "SELECT * FROM (SELECT x, y FROM {0}) WHERE y IS NOT NULL"


def add(name: str, datalog: str, columns: str, sql: str, rules: tuple[str, ...] = (), rounded: dict[str, int] | None = None) -> None:
    """A query over the relations. Doubles whose sums depend on order are rounded on both sides."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        engine = relations(spark, folder)
        for r in rules:
            engine.execute(f"(rule [{r}])")
        df = engine.query(f"(query [{datalog}])").toDF(*columns.split())
        return df.withColumns({c: F.round(c, k) for c, k in (rounded or {}).items()})

    QUERIES[name], SQL[name] = run, sql


# --- patterns and joins ------------------------------------------------------------------------------------------------
add("scan_attr", ":find ?o ?s :where [?o :order/status ?s]", "o s", "SELECT o_orderkey AS o, o_orderstatus AS s FROM orders")
add("scan_entity", ":find ?n ?b :where [:customer/7 :customer/name ?n] [:customer/7 :customer/acctbal ?b]", "n b", "SELECT c_name AS n, c_acctbal AS b FROM customer WHERE c_custkey = 7")
add("pattern_const_str", ":find ?c ?b :where [?c :customer/mktsegment \"BUILDING\"] [?c :customer/acctbal ?b]", "c b", "SELECT c_custkey AS c, c_acctbal AS b FROM customer WHERE c_mktsegment = 'BUILDING'")
add("pattern_const_int", ":find ?p ?n :where [?p :part/size 15] [?p :part/name ?n]", "p n", "SELECT p_partkey AS p, p_name AS n FROM part WHERE p_size = 15")
add("pattern_const_float", ":find (count ?q) :where [?l :lineitem/discount 0.05] [?l :lineitem/quantity ?q]", "n", "SELECT count(*) AS n FROM lineitem WHERE abs(l_discount - 0.05) < 2.220446049250313e-16")
add("pattern_attr_var", ":find ?a (count ?v) :where [?n ?a ?v] [?n :nation/name ?m]", "a n", "SELECT ':nation/name' AS a, count(*) AS n FROM nation UNION ALL SELECT ':nation/region', count(*) FROM nation")
add("pattern_entity_const_ref", ":find ?n :where [?n :nation/region :region/1]", "n", "SELECT n_nationkey::BIGINT AS n FROM nation WHERE n_regionkey = 1")
add("wildcard", ":find ?s :where [_ :order/status ?s]", "s", "SELECT o_orderstatus AS s FROM orders")
add("self_unify", ":find ?h :where [?h :hop/next ?h]", "h", f"WITH {HOP} SELECT x AS h FROM hop WHERE x = y")
add("join_ref", ":find ?o ?n :where [?o :order/customer ?c] [?c :customer/name ?n]", "o n", "SELECT o_orderkey AS o, c_name AS n FROM orders JOIN customer ON o_custkey = c_custkey")
add("join_star", ":find ?q ?p ?f :where [?l :lineitem/quantity ?q] [?l :lineitem/extendedprice ?p] [?l :lineitem/returnflag ?f] [?l :lineitem/linenumber 1]", "q p f", "SELECT l_quantity AS q, l_extendedprice + 0.0 AS p, l_returnflag AS f FROM lineitem WHERE l_linenumber = 1")
add(
    "join_3hop", ":find ?r (count ?t) :where [?l :lineitem/order ?o] [?l :lineitem/tax ?t] [?o :order/customer ?c] [?c :customer/nation ?n] [?n :nation/region ?g] [?g :region/name ?r]", "r n",
    "SELECT r_name AS r, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
)
add("join_theta", ":find ?a ?b :where [?a :supplier/acctbal ?x] [?b :supplier/acctbal ?y] [?a :supplier/nation ?n] [?b :supplier/nation ?n] [(< ?x ?y)]", "a b", "SELECT s.s_suppkey AS a, t.s_suppkey AS b FROM supplier s JOIN supplier t ON s.s_nationkey = t.s_nationkey AND s.s_acctbal < t.s_acctbal")
add("join_cross", ":find ?r ?n :where [?x :region/name ?r] [?y :nation/name ?n]", "r n", "SELECT r_name AS r, n_name AS n FROM region, nation")
add("join_value", ":find ?p ?h :where [?p :part/size ?x] [?h :hop/number ?x]", "p h", "SELECT p_partkey AS p, n_nationkey::BIGINT AS h FROM part JOIN nation ON p_size = n_nationkey")
add("join_reverse_ref", ":find ?c (count ?t) :where [?n :nation/name \"NATION_3\"] [?c :customer/nation ?n] [?o :order/customer ?c] [?o :order/totalprice ?t]", "c n", "SELECT c_custkey AS c, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE n_name = 'NATION_3' GROUP BY 1")

# --- expressions -------------------------------------------------------------------------------------------------------
for _name, _op, _sql in (("add", "+", "p_size + p_partkey"), ("sub", "-", "p_size - p_partkey"), ("mul", "*", "p_size * p_partkey")):
    add(f"expr_{_name}", f":find ?p ?r :where [?p :part/size ?s] [?l :lineitem/part ?p] [?l :lineitem/linenumber ?k] [({_op} ?s ?k) ?r]", "p r", f"SELECT p_partkey AS p, ({_sql.replace('p_partkey', 'l_linenumber')})::BIGINT AS r FROM part JOIN lineitem ON l_partkey = p_partkey")
add("expr_div_int", ":find ?p ?r :where [?p :part/size ?s] [(- ?s 30) ?d] [(/ ?d 7) ?r]", "p r", "SELECT p_partkey AS p, ((p_size - 30) // 7)::BIGINT AS r FROM part")
add("expr_div_zero", ":find ?p ?r :where [?p :part/size ?s] [(- ?s 15) ?d] [(/ 100 ?d) ?r]", "p r", "SELECT p_partkey AS p, (100 // (p_size - 15))::BIGINT AS r FROM part WHERE p_size <> 15")
add("expr_float_div", ":find ?p ?r :where [?p :part/retailprice ?x] [?p :part/size ?s] [(/ ?x ?s) ?r]", "p r", "SELECT p_partkey AS p, p_retailprice / p_size AS r FROM part WHERE p_size <> 0")
add("expr_wrap", ":find ?p ?r :where [?p :part/size ?s] [(* ?s 9223372036854775807) ?r]", "p r", "SELECT p_partkey AS p, CASE WHEN (p_size % 2) = 0 THEN (-p_size)::BIGINT ELSE (9223372036854775807 - p_size + 1)::BIGINT END AS r FROM part")
add("expr_nested", ":find ?p ?r :where [?p :part/size ?s] [?p :part/retailprice ?x] [(+ (* ?s 2) (- ?x 1.5)) ?r]", "p r", "SELECT p_partkey AS p, p_size * 2 + (p_retailprice - 1.5) AS r FROM part")
for _name, _op, _sql in (("lt", "<", "<"), ("gt", ">", ">"), ("lte", "<=", "<="), ("gte", ">=", ">="), ("eq", "=", "="), ("neq", "!=", "<>")):
    add(f"expr_{_name}", f":find ?p :where [?p :part/size ?s] [({_op} ?s 25)]", "p", f"SELECT p_partkey AS p FROM part WHERE p_size {_sql} 25")
add("expr_eq_xtype", ":find ?p :where [?p :part/size ?s] [(= ?s 25.0)]", "p", "SELECT p_partkey AS p FROM part WHERE false")
add("expr_cmp_mixed", ":find ?p :where [?p :part/size ?s] [(> ?s 24.5)]", "p", "SELECT p_partkey AS p FROM part WHERE p_size > 24.5")
add("expr_cmp_wrong_type", ":find ?p :where [?p :part/name ?s] [(> ?s 1)]", "p", "SELECT p_partkey AS p FROM part WHERE false")
add("expr_starts", ":find ?p ?t :where [?p :part/type ?t] [(starts-with? ?t \"PROMO\")]", "p t", "SELECT p_partkey AS p, p_type AS t FROM part WHERE starts_with(p_type, 'PROMO')")
add("expr_ends", ":find ?p ?b :where [?p :part/brand ?b] [(ends-with? ?b \"3\")]", "p b", "SELECT p_partkey AS p, p_brand AS b FROM part WHERE ends_with(p_brand, '3')")
add("expr_contains", ":find ?c ?n :where [?c :customer/name ?n] [(contains? ?n \"12\")]", "c n", "SELECT c_custkey AS c, c_name AS n FROM customer WHERE contains(c_name, '12')")
add("expr_matches", ":find ?c ?n :where [?c :customer/name ?n] [(matches? ?n \"0+[13579]$\")]", "c n", "SELECT c_custkey AS c, c_name AS n FROM customer WHERE regexp_matches(c_name, '0+[13579]$')")
add("type_preds", ":find ?s ?x :where [?p :part/size ?s] [?p :part/retailprice ?x] [?p :part/name ?n] [(integer? ?s)] [(float? ?x)] [(string? ?n)] [(nil? ?n) ?z] [(= ?z false)]", "s x", "SELECT p_size::BIGINT AS s, p_retailprice AS x FROM part")

# --- negation and disjunction ------------------------------------------------------------------------------------------
add("not_basic", ":find ?c :where [?c :customer/name ?n] (not [?c :customer/mktsegment \"BUILDING\"])", "c", "SELECT c_custkey AS c FROM customer WHERE c_mktsegment <> 'BUILDING'")
add("not_expr", ":find ?p :where [?p :part/size ?s] (not [(> ?s 20)])", "p", "SELECT p_partkey AS p FROM part WHERE NOT p_size > 20")
add("not_expr_fails", ":find ?p :where [?p :part/name ?n] (not [(> ?n 20)])", "p", "SELECT p_partkey AS p FROM part")
add("not_join", ":find ?c :where [?c :customer/name ?n] (not-join [?c] [?o :order/customer ?c] [?o :order/status \"F\"])", "c", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
add("not_join_expr", ":find ?c :where [?c :customer/acctbal ?b] (not-join [?c ?b] [?o :order/customer ?c] [?o :order/totalprice ?t] [(> ?t (* ?b 40.0))])", "c", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40.0)")
add("not_join_unlinked", ":find ?n :where [?x :region/name ?n] [?x :region/name ?m] (not-join [?m] [?s :supplier/name ?q] [(= ?q \"nobody\")])", "n", "SELECT r_name AS n FROM region WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_name = 'nobody')")
add("not_rule", ":find ?c :where [?c :customer/name ?n] (not (open ?c))", "c", "SELECT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')", rules=("(open ?c) [?o :order/customer ?c] [?o :order/status \"O\"]",))
add("or_basic", ":find ?p :where [?p :part/name ?n] (or [?p :part/size 1] [?p :part/size 2])", "p", "SELECT p_partkey AS p FROM part WHERE p_size IN (1, 2)")
add("or_and", ":find ?p ?b :where [?p :part/brand ?b] (or (and [?p :part/size ?s] [(< ?s 5)] [?p :part/retailprice ?x]) (and [?p :part/size ?s] [?p :part/retailprice ?x] [(> ?x 1900.0)]))", "p b", "SELECT p_partkey AS p, p_brand AS b FROM part WHERE p_size < 5 OR p_retailprice > 1900.0")
add("or_nested", ":find ?p :where [?p :part/name ?n] (or [?p :part/size 1] (or [?p :part/size 2] [?p :part/brand \"Brand#11\"]))", "p", "SELECT p_partkey AS p FROM part WHERE p_size IN (1, 2) OR p_brand = 'Brand#11'")
add("or_not", ":find ?p :where [?p :part/size ?s] (or [?p :part/size 3] (and [?p :part/brand \"Brand#11\"] (not [(> ?s 10)])))", "p", "SELECT p_partkey AS p FROM part WHERE p_size = 3 OR p_brand = 'Brand#11' AND NOT p_size > 10")
add("or_new_var", ":find ?n ?w :where [?n :nation/name ?x] (or [?c :customer/nation ?n] [?c :supplier/nation ?n]) [?n :nation/region ?r] [?r :region/name ?w]", "n w", "SELECT DISTINCT n_nationkey::BIGINT AS n, r_name AS w, k FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (SELECT c_nationkey AS nk, 'c' || c_custkey AS k FROM customer UNION ALL SELECT s_nationkey, 's' || s_suppkey FROM supplier) ON nk = n_nationkey")
SQL["or_new_var"] = f"SELECT n, w FROM ({SQL['or_new_var']})"
add("or_join", ":find ?c ?n :where [?c :customer/name ?n] (or-join [?c] (and [?o :order/customer ?c] [?o :order/priority \"1-URGENT\"]) [?c :customer/mktsegment \"MACHINERY\"])", "c n", "SELECT c_custkey AS c, c_name AS n FROM customer WHERE c_mktsegment = 'MACHINERY' OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")

# --- aggregates --------------------------------------------------------------------------------------------------------
add("agg_count", ":find (count ?s) :where [_ :order/status ?s]", "n", "SELECT count(*) AS n FROM orders")
add("agg_count_distinct", ":find (count-distinct ?c) :where [?o :order/customer ?c]", "n", "SELECT count(DISTINCT o_custkey) AS n FROM orders")
add("agg_sum", ":find (sum ?s) :where [?p :part/size ?s]", "n", "SELECT sum(p_size)::BIGINT AS n FROM part")
add("agg_sum_distinct", ":find ?b (sum-distinct ?s) :where [?p :part/size ?s] [?p :part/brand ?b]", "b n", "SELECT p_brand AS b, sum(DISTINCT p_size)::BIGINT AS n FROM part GROUP BY 1")
add("agg_min", ":find ?b (min ?x) :where [?p :part/brand ?b] [?p :part/retailprice ?x]", "b x", "SELECT p_brand AS b, min(p_retailprice) AS x FROM part GROUP BY 1")
add("agg_max", ":find ?b (max ?n) :where [?p :part/brand ?b] [?p :part/name ?n]", "b n", "SELECT p_brand AS b, max(p_name) AS n FROM part GROUP BY 1")
add("agg_group", ":find ?f ?s (sum ?q) (count ?q) (min ?q) (max ?q) :where [?l :lineitem/returnflag ?f] [?l :lineitem/linestatus ?s] [?l :lineitem/quantity ?q]", "f s q n lo hi", "SELECT l_returnflag AS f, l_linestatus AS s, round(sum(l_quantity), 2) AS q, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1, 2", rounded={"q": 2})
add("agg_with", ":find ?s (sum ?t) :with ?c :where [?o :order/status ?s] [?o :order/customer ?c] [?o :order/totalprice ?t]", "s t", "SELECT o_orderstatus AS s, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY o_orderstatus, o_custkey", rounded={"t": 2})
add("agg_bag", ":find ?s (count ?s) :where [_ :order/status ?s]", "s n", "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1")
add("agg_empty_count", ":find (count ?p) :where [?p :part/size -1]", "n", "SELECT 0::BIGINT AS n")
add("agg_empty_sum", ":find (sum ?s) :where [?p :part/size ?s] [(< ?s 0)]", "n", "SELECT 1::BIGINT AS n WHERE false")
add("agg_expr", ":find ?f (sum ?r) :where [?l :lineitem/returnflag ?f] [?l :lineitem/extendedprice ?p] [?l :lineitem/discount ?d] [(* ?p (- 1.0 ?d)) ?r]", "f r", "SELECT l_returnflag AS f, round(sum(l_extendedprice * (1.0 - l_discount)), 1) AS r FROM lineitem GROUP BY 1", rounded={"r": 1})
add(
    "revenue_by_segment",
    ":find ?seg (sum ?rev) (count ?l) :where [?l :lineitem/order ?o] [?l :lineitem/extendedprice ?p] [?l :lineitem/discount ?d] [?o :order/customer ?c] [?c :customer/mktsegment ?seg] [(- 1.0 ?d) ?f] [(* ?p ?f) ?rev]",
    "seg rev n", "SELECT c_mktsegment AS seg, round(sum(l_extendedprice * (1.0 - l_discount)), 1) AS rev, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1", rounded={"rev": 1},
)
QUERIES["revenue_by_segment"].__doc__ = "The flagship query."

# --- windows -----------------------------------------------------------------------------------------------------------
_ROWS = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
for _f in ("sum", "count", "min", "max", "avg"):
    _cast = "::BIGINT" if _f == "sum" else ""
    add(f"win_{_f}", f":find ?k ({_f} ?s :over (:partition-by ?b :order-by ?k)) :where [?k :part/size ?s] [?k :part/brand ?b]", "k w", f"SELECT p_partkey AS k, {'round(' * (_f == 'avg')}({_f}(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey {_ROWS})){_cast or ('::BIGINT' if _f != 'avg' else '')}{', 6)' * (_f == 'avg')} AS w FROM part", rounded={"w": 6} if _f == "avg" else None)
add("win_rank", ":find ?k ?s (rank :over (:order-by ?s)) :where [?k :supplier/nation ?s]", "k s r", "SELECT s_suppkey AS k, s_nationkey::BIGINT AS s, rank() OVER (ORDER BY s_nationkey) AS r FROM supplier")
add("win_row_number", ":find ?n (row-number :over (:partition-by ?g :order-by ?n)) :where [?x :nation/name ?n] [?x :nation/region ?g]", "n r", "SELECT n_name AS n, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS r FROM nation")
add("win_desc", ":find ?k (rank :over (:partition-by ?b :order-by ?x :desc)) :where [?k :part/brand ?b] [?k :part/retailprice ?x]", "k r", "SELECT p_partkey AS k, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS r FROM part")
add("win_partition", ":find ?o (count ?t :over (:partition-by ?c :order-by ?o)) :where [?o :order/customer ?c] [?o :order/totalprice ?t]", "o n", f"SELECT o_orderkey AS o, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey {_ROWS}) AS n FROM orders")
add("win_multi", ":find ?n (row-number :over (:order-by ?n)) (row-number :over (:order-by ?n :desc)) :where [?x :nation/name ?n]", "n a d", "SELECT n_name AS n, row_number() OVER (ORDER BY n_name) AS a, row_number() OVER (ORDER BY n_name DESC) AS d FROM nation")
add("win_over_agg", ":find ?b (sum ?s) (rank :over (:order-by ?b)) :where [?p :part/brand ?b] [?p :part/size ?s]", "b s r", "SELECT b, s, rank() OVER (ORDER BY b) AS r FROM (SELECT p_brand AS b, sum(p_size)::BIGINT AS s FROM part GROUP BY 1)")

# --- rules -------------------------------------------------------------------------------------------------------------
ANCESTOR = ("(ancestor ?x ?y) [?x :tree/parent ?y]", "(ancestor ?x ?y) [?x :tree/parent ?m] (ancestor ?m ?y)")
REACH = ("(reach ?x ?y) [?x :hop/next ?y]", "(reach ?x ?y) [?x :hop/next ?m] (reach ?m ?y)")
LATER = ("(later ?x ?y) [?x :chain/next ?y]", "(later ?x ?y) (later ?x ?m) [?m :chain/next ?y]")


def _closure(edges: str, table: str) -> str:
    return f"WITH RECURSIVE {edges}, e AS ({LIVE.format(table)}), r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)"


add("rule_tc", ":find ?x ?y :where (ancestor ?x ?y)", "x y", f"{_closure(TREE, 'tree')} SELECT x, y FROM r", ANCESTOR)
add("rule_cycle", ":find ?x ?y :where (reach ?x ?y)", "x y", f"{_closure(HOP, 'hop')} SELECT x, y FROM r", REACH)
add("rule_chain", ":find ?x (count ?y) :where (later ?x ?y)", "x n", f"{_closure(CHAIN, 'chain')} SELECT x, count(*) AS n FROM r GROUP BY x", LATER)
add("rule_bound_bf", ":find ?y :where (ancestor :tree/150 ?y)", "y", f"{_closure(TREE, 'tree')} SELECT y FROM r WHERE x = 150", ANCESTOR)
add("rule_bound_fb", ":find ?x :where (ancestor ?x :tree/5)", "x", f"{_closure(TREE, 'tree')} SELECT x FROM r WHERE y = 5", ANCESTOR)
add("rule_bound_bb", ":find (count ?n) :where (ancestor :tree/150 :tree/4) [?x :region/name ?n]", "n", f"{_closure(TREE, 'tree')} SELECT CASE WHEN EXISTS (SELECT 1 FROM r WHERE x = 150 AND y = 4) THEN (SELECT count(*) FROM region) ELSE 0 END AS n", ANCESTOR)
add(
    "rule_mutual", ":find ?x ?y :where (even ?x ?y)", "x y",
    f"WITH RECURSIVE {TREE}, e AS ({LIVE.format('tree')}), r AS (SELECT x, y, 1 AS k FROM e UNION SELECT r.x, e.y, 1 - r.k FROM r JOIN e ON r.y = e.x) SELECT x, y FROM r WHERE k = 0",
    ("(odd ?x ?y) [?x :tree/parent ?y]", "(odd ?x ?y) (even ?x ?m) [?m :tree/parent ?y]", "(even ?x ?y) (odd ?x ?m) [?m :tree/parent ?y]"),
)
add("rule_strat_neg", ":find ?x ?p :where [?x :tree/parent ?p] (leaf ?x)", "x p", f"WITH {TREE} SELECT x, y AS p FROM tree WHERE y IS NOT NULL AND x NOT IN (SELECT y FROM tree WHERE y IS NOT NULL)", ("(inner ?y) [?x :tree/parent ?y]", "(leaf ?x) [?x :tree/parent ?p] (not (inner ?x))"))
add("rule_expr", ":find ?p :where (bulky ?p)", "p", "SELECT p_partkey AS p FROM part WHERE p_size * 2 > 80", ("(bulky ?p) [?p :part/size ?s] [(* ?s 2) ?d] [(> ?d 80)]",))
add("rule_or", ":find ?p :where (odd ?p)", "p", "SELECT p_partkey AS p FROM part WHERE p_size = 1 OR p_brand = 'Brand#12'", ("(odd ?p) [?p :part/name ?n] (or [?p :part/size 1] [?p :part/brand \"Brand#12\"])",))
add("rule_union_heads", ":find ?p :where (odd ?p)", "p", "SELECT p_partkey AS p FROM part WHERE p_size = 1 OR p_brand = 'Brand#12'", ("(odd ?p) [?p :part/size 1]", "(odd ?p) [?p :part/brand \"Brand#12\"]"))
add(
    "rule_same_generation", ":find ?x (count ?y) :where (sg ?x ?y)", "x n",
    f"WITH RECURSIVE {TREE}, e AS (SELECT x, y FROM tree WHERE y IS NOT NULL), r AS (SELECT a.x AS x, b.x AS y FROM e a JOIN e b ON a.y = b.y UNION SELECT a.x, b.x FROM r JOIN e a ON a.y = r.x JOIN e b ON b.y = r.y) SELECT x, count(*) AS n FROM r GROUP BY x",
    ("(edge ?x ?y) [?x :tree/parent ?y]", "(sg ?x ?y) (edge ?x ?p) (edge ?y ?p)", "(sg ?x ?y) (edge ?x ?a) (sg ?a ?b) (edge ?y ?b)"),
)
add("rule_agg", ":find ?y (count ?x) (max ?s) :where (ancestor ?x ?y) [?x :tree/size ?s]", "y n s", f"{_closure(TREE, 'tree')} SELECT r.y, count(*) AS n, max(p_size)::BIGINT AS s FROM r JOIN part ON p_partkey = r.x GROUP BY 1", ANCESTOR)

add("limit_holds", ":find ?n :max-results 25 :where [?x :nation/name ?n]", "n", "SELECT n_name AS n FROM nation")

# --- user functions and prepared queries -------------------------------------------------------------------------------


def _named(name: str, sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return register


@_named("prep_slots", "SELECT p_partkey AS p FROM part WHERE p_brand = 'Brand#11' AND p_size < 20")
def prep_slots(spark: SparkSession, folder: str) -> DataFrame:
    prepared = relations(spark, folder).prepare("(query [:find ?p :where [?p :part/brand $brand] [?p :part/size ?s] [(< ?s $most)]])")
    return prepared.execute(brand="Brand#11", most=20).toDF("p")


@_named("prep_entity_slot", "SELECT o_orderkey AS o FROM orders WHERE o_custkey = 11")
def prep_entity_slot(spark: SparkSession, folder: str) -> DataFrame:
    return relations(spark, folder).prepare("(query [:find ?o :where [?o :order/customer $c]])").execute(c=("kw", ":customer/11")).toDF("o")


@_named("udf_pred", "SELECT p_partkey AS p FROM part WHERE p_size % 7 = 3")
def udf_pred(spark: SparkSession, folder: str) -> DataFrame:
    engine = relations(spark, folder)
    engine.register_predicate("seventh?", lambda c: c % 7 == 3)
    return engine.query("(query [:find ?p :where [?p :part/size ?s] [(seventh? ?s)]])").toDF("p")


GEOMEAN = UserAggregate(lambda: 0.0, lambda state, x: state + float(np.log(x)), lambda state, n: float(np.exp(state / n)))


@_named("udaf_geomean", "SELECT p_brand AS b, round(exp(avg(ln(p_retailprice))), 6) AS g FROM part GROUP BY 1")
def udaf_geomean(spark: SparkSession, folder: str) -> DataFrame:
    engine = relations(spark, folder)
    engine.register_aggregate("geomean", GEOMEAN)
    df = engine.query("(query [:find ?b (geomean ?x) :where [?p :part/brand ?b] [?p :part/retailprice ?x]])").toDF("b", "g")
    return df.withColumn("g", F.round("g", 6))


@_named("udaf_window", "SELECT n_nationkey::BIGINT AS n, round(exp(avg(ln(n_nationkey + 1)) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS g FROM nation")
def udaf_window(spark: SparkSession, folder: str) -> DataFrame:
    engine = relations(spark, folder)
    engine.register_aggregate("geomean", GEOMEAN)
    df = engine.query("(query [:find ?k (geomean ?k1 :over (:partition-by ?g :order-by ?k)) :where [?n :hop/number ?k] [?n :hop/region ?g] [(+ ?k 1) ?k1]])").toDF("n", "g")
    return df.withColumn("g", F.round("g", 6))


# --- the fact log ------------------------------------------------------------------------------------------------------
DAY = 86_400_000


_logs: dict[tuple[str, str], tuple[DataFrame, int]] = {}


def event_log(spark: SparkSession, folder: str) -> Engine:
    """An engine over the log that is made from events, which is loaded once a session, sorted by attribute and entity."""
    key = spark.sparkContext.applicationId, folder
    if key not in _logs:
        rows = written(_event_rows(spark, folder).repartitionByRange("a", "e").sortWithinPartitions("a", "e"), "events")
        _logs[key] = rows, rows.agg(F.max("tx_count")).first()[0] or 0
    log = MemoryLog(spark)
    rows, log.head = _logs[key]
    log.frames.append(rows)
    return Engine(spark, log=log)


def _event_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Records made from events: each sets its user's :user/last-event and :user/value until the user's next one (every 11th for a day
    longer); every 7th window and every 97th fact is retracted later. Users have their number as :user/id."""
    events = spark.read.parquet(f"{folder}/events.parquet").withColumn("ms", millis_of(F.col("ts")))
    events = events.withColumn("next", F.lead("ms").over(Window.partitionBy("user_id").orderBy("ms", "event_id")))
    late = F.when((F.col("event_id") % 11 == 0) & F.col("next").isNotNull(), DAY).otherwise(0)
    events = events.withColumn("e", keyword_entity(F.concat(F.lit(":user/"), F.col("user_id").cast("string")))).withColumn("end", F.coalesce(F.col("next") + late, F.lit(FOREVER)))

    def facts(a: str, v, df: DataFrame, start, end, tx, asserted: bool) -> DataFrame:
        columns = {"e": F.col("e"), "a": F.lit(a), "v": v, "tx_id": F.col("ms"), "tx_count": tx, "valid_from": start, "valid_to": end, "asserted": F.lit(asserted), "seq": F.lit(0)}
        return df.select(*(columns[f.name].cast(f.dataType).alias(f.name) for f in SCHEMA.fields))

    made = []
    tx = F.col("event_id") + 1
    kind, value = struct(4, s=F.col("event_type")), struct(3, d=F.col("value"))
    for a, v in ((":user/last-event", kind), (":user/value", value)):
        made.append(facts(a, v, events, F.col("ms"), F.col("end"), tx, True))
        made.append(facts(a, v, events.where("event_id % 7 = 0"), F.col("ms"), F.col("end"), tx + 1_000_000, False))
        made.append(facts(a, v, events.where("event_id % 97 = 0"), F.lit(ALL_TIME), F.lit(FOREVER), tx + 2_000_000, False))
    users = events.groupBy("user_id", "e").agg(F.min("ms").alias("ms"))
    made.append(facts(":user/id", struct(2, i=F.col("user_id")), users, F.lit(0), F.lit(FOREVER), F.lit(1), True))
    return functools.reduce(DataFrame.unionByName, made)


#: The same log and its net windows in SQL, cut at a condition on its transactions.
_LOG = """
WITH ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS ms, lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS nx FROM events),
w AS (SELECT *, CASE WHEN nx IS NULL THEN 9223372036854775807 WHEN event_id % 11 = 0 THEN nx + 86400000 ELSE nx END AS ed FROM ev),
f AS (SELECT *, 'k' AS a, event_type AS s, NULL::DOUBLE AS d FROM w UNION ALL SELECT *, 'v', NULL, value FROM w),
log AS (
  SELECT user_id, a, s, d, event_id + 1 AS tx, ms AS txid, ms AS vf, ed AS vt, 0 AS kind FROM f
  UNION ALL SELECT user_id, a, s, d, event_id + 1000001, ms, ms, ed, 1 FROM f WHERE event_id % 7 = 0
  UNION ALL SELECT user_id, a, s, d, event_id + 2000001, ms, NULL, NULL, 2 FROM f WHERE event_id % 97 = 0),
cut AS (SELECT * FROM log WHERE {cut}),
allcut AS (SELECT user_id, a, s, d, max(tx) AS tx FROM cut WHERE kind = 2 GROUP BY ALL),
one AS (SELECT user_id, a, s, d, vf, vt, max(tx) FILTER (kind = 0) AS put, max(tx) FILTER (kind = 1) AS gone, max(txid) FILTER (kind = 0) AS txid FROM cut WHERE kind < 2 GROUP BY ALL),
net AS (
  SELECT one.* FROM one LEFT JOIN allcut c ON one.user_id = c.user_id AND one.a = c.a AND one.s IS NOT DISTINCT FROM c.s AND one.d IS NOT DISTINCT FROM c.d
  WHERE put > greatest(coalesce(gone, -1), coalesce(c.tx, -1)))
"""
_INSTANT = 1_704_672_000_000


def _log(cut: str = "true") -> str:
    return _LOG.format(cut=cut)


def on_log(name: str, datalog: str, columns: str, sql: str, cut: str = "true") -> None:
    """A query over the event log; columns name:field take a field of the value struct."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = event_log(spark, folder).query(f"(query [{datalog}])")
        specs = [c.partition(":") for c in columns.split()]
        df = df.toDF(*(n for n, _, _ in specs))
        return df.select(*(F.col(n)[f].alias(n) if f else F.col(n) for n, _, f in specs))

    QUERIES[name], SQL[name] = run, _log(cut) + sql


on_log("asof_count", ":find ?id (count ?t) :as-of 5000 :any-valid-time :where [?u :user/id ?id] [?u :user/last-event ?t]", "id:i n", "SELECT user_id AS id, count(*) AS n FROM net WHERE a = 'k' GROUP BY 1", "tx <= 5000")
on_log("asof_ts", ':find ?t (count ?u) :as-of "2024-01-20T00:00:00Z" :any-valid-time :where [?u :user/last-event ?t]', "t:s n", "SELECT s AS t, count(*) AS n FROM net WHERE a = 'k' GROUP BY 1", "txid <= 1705708800000")
on_log("valid_at", ':find ?id ?t :valid-at "2024-01-08" :where [?u :user/id ?id] [?u :user/last-event ?t]', "id:i t:s", f"SELECT DISTINCT user_id AS id, s AS t FROM net WHERE a = 'k' AND vf <= {_INSTANT} AND {_INSTANT} < vt")
on_log("valid_now", ":find (count ?x) :where [?u :user/value ?x]", "n", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id, d FROM net WHERE a = 'v' AND vt = 9223372036854775807)")
on_log("any_valid", ":find ?id (count ?x) :any-valid-time :where [?u :user/id ?id] [?u :user/value ?x]", "id:i n", "SELECT user_id AS id, count(*) AS n FROM net WHERE a = 'v' GROUP BY 1")
on_log("coalesce", ':find ?t (count ?u) :valid-at "2024-01-08T00:00:00Z" :where [?u :user/last-event ?t]', "t:s n", f"SELECT s AS t, count(*) AS n FROM (SELECT DISTINCT user_id, s FROM net WHERE a = 'k' AND vf <= {_INSTANT} AND {_INSTANT} < vt) GROUP BY 1")
on_log("net_assert", ":find (count ?t) :any-valid-time :where [?u :user/last-event ?t]", "n", "SELECT count(*) AS n FROM net WHERE a = 'k'")
on_log("scoped_retract", ":find (count ?t) :as-of 1900000 :any-valid-time :where [?u :user/last-event ?t]", "n", "SELECT count(*) AS n FROM net WHERE a = 'k'", "tx <= 1900000")
on_log("pseudo_vf_vt", ":find ?id ?f ?t :any-valid-time :where [?u :user/id ?id] [?u :user/value ?x] [?u :db/valid-from ?f] [?u :db/valid-to ?t]", "id:i f t", "SELECT user_id AS id, vf AS f, vt AS t FROM net WHERE a = 'v'")
on_log("pseudo_tx", ":find ?c ?i :any-valid-time :where [?u :user/last-event ?x] [?u :db/tx-count ?c] [?u :db/tx-id ?i]", "c i", "SELECT put AS c, txid AS i FROM net WHERE a = 'k'")
on_log("pseudo_valid_at", ':find ?t ?at :valid-at "2024-01-08" :where [?u :user/last-event ?t] [?u :db/valid-at ?at]', "t:s at", f"SELECT s AS t, {_INSTANT} AS at FROM (SELECT DISTINCT user_id, s FROM net WHERE a = 'k' AND vf <= {_INSTANT} AND {_INSTANT} < vt)")
on_log("interval_overlap", f":find (count ?x) :any-valid-time :where [?u :user/value ?x] [?u :db/valid-from ?f] [?u :db/valid-to ?t] [(< ?f {_INSTANT + DAY})] [(> ?t {_INSTANT})]", "n", f"SELECT count(*) AS n FROM net WHERE a = 'v' AND vf < {_INSTANT + DAY} AND vt > {_INSTANT}")
on_log("log_join_sum", ':find ?t (sum ?x) :valid-at "2024-01-08" :where [?u :user/last-event ?t] [?u :user/value ?x] [(> ?x 50.0)]', "t:s x:d", f"SELECT s AS t, round(sum(d), 4) AS x FROM (SELECT DISTINCT user_id, s FROM net WHERE a = 'k' AND vf <= {_INSTANT} AND {_INSTANT} < vt) JOIN (SELECT DISTINCT user_id, d FROM net WHERE a = 'v' AND vf <= {_INSTANT} AND {_INSTANT} < vt) USING (user_id) WHERE d > 50 GROUP BY 1")
_unrounded = QUERIES["log_join_sum"]
QUERIES["log_join_sum"] = lambda spark, folder: _unrounded(spark, folder).withColumn("x", F.round("x", 4))
on_log("log_not", ':find ?id :valid-at "2024-01-08" :where [?u :user/id ?id] (not-join [?u] [?u :user/last-event ?t])', "id:i", f"SELECT DISTINCT user_id AS id FROM ev WHERE user_id NOT IN (SELECT user_id FROM net WHERE a = 'k' AND vf <= {_INSTANT} AND {_INSTANT} < vt)")


@_named("valid_diff", _log() + f"""
, o AS (SELECT DISTINCT user_id, s FROM net WHERE a = 'k' AND vf <= {_INSTANT} AND {_INSTANT} < vt), n AS (SELECT DISTINCT user_id, s FROM net WHERE a = 'k' AND vf <= {_INSTANT + 2 * DAY} AND {_INSTANT + 2 * DAY} < vt)
SELECT s AS t, 'appeared' AS change, count(*) AS n FROM (SELECT * FROM n EXCEPT SELECT * FROM o) GROUP BY 1 UNION ALL SELECT s, 'disappeared', count(*) FROM (SELECT * FROM o EXCEPT SELECT * FROM n) GROUP BY 1""")
def valid_diff(spark: SparkSession, folder: str) -> DataFrame:
    diff = event_log(spark, folder).read_view(valid_at=ANY_TIME).diff_frame(":user/last-event", _INSTANT, _INSTANT + 2 * DAY)
    return diff.groupBy(F.col("v.s").alias("t"), "change").agg(F.count("*").alias("n"))


@_named("fact_log_since", _log() + "SELECT tx AS tx_count, count(*) AS n FROM log WHERE tx > 9000 GROUP BY 1")
def fact_log_since(spark: SparkSession, folder: str) -> DataFrame:
    return event_log(spark, folder).export_fact_log_since(9000).groupBy("tx_count").agg(F.count("*").alias("n"))


@_named("transact_folder", "SELECT user_id AS id, count(*) + CASE WHEN user_id = 1 THEN 1 ELSE 0 END AS n FROM events GROUP BY user_id")
def transact_folder(spark: SparkSession, folder: str) -> DataFrame:
    """References of all events to their users, from a log in a folder: a bulk commit, a transaction of two facts, one of them retracted again, and
    a compaction; counted by user, against the references' direction."""
    engine = Engine.open(spark, f"{shared_dir(spark)}/tidemark-log-{uuid.uuid4().hex}", clock=lambda: _INSTANT)
    events = spark.read.parquet(f"{folder}/events.parquet")
    user = keyword_entity(F.concat(F.lit(":user/"), F.col("user_id").cast("string")))
    engine.load(events.select(keyword_entity(F.concat(F.lit(":event/"), F.col("event_id").cast("string"))).alias("e"), F.lit(":event/user").alias("a"), struct(6, s=user).alias("v")))
    engine.load(events.select(user.alias("e"), F.lit(":user/id").alias("a"), struct(2, i=F.col("user_id").cast("long")).alias("v")).distinct())
    engine.execute("(transact [[:event/one-more :event/user :user/1] [:event/taken-back :event/user :user/1]])")
    engine.execute("(retract [[:event/taken-back :event/user :user/1]])")
    engine.compact()
    df = engine.query("(query [:find ?id (count ?e) :where [?e :event/user ?u] [?u :user/id ?id]])").toDF("id", "n")
    return df.select(F.col("id")["i"].alias("id"), "n")


@_named("forget_facts", "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 1704672000000 ELSE 9223372036854775807 END AS ed FROM events")
def forget_facts(spark: SparkSession, folder: str) -> DataFrame:
    """A fact of every event, valid from a day before the instant; those of even events are forgotten at the instant."""
    return _forgotten(spark, spark.read.parquet(f"{folder}/events.parquet"))


def _forgotten(spark: SparkSession, events: DataFrame) -> DataFrame:
    engine = Engine.memory(spark, clock=lambda: _INSTANT)
    entity = keyword_entity(F.concat(F.lit(":event/"), F.col("event_id").cast("string")))
    engine.load(events.select(entity.alias("e"), F.lit(":event/id").alias("a"), struct(2, i=F.col("event_id")).alias("v"), F.lit(_INSTANT - DAY).alias("valid_from")))
    engine.load(events.where("event_id % 2 = 0").select(entity.alias("e"), F.lit(":event/even").alias("a"), struct(1, i=F.lit(1)).alias("v"), F.lit(_INSTANT - DAY).alias("valid_from")))
    engine.run(parse('(forget {:valid-to "2024-01-08"} [:find ?e ?a ?v :where [?e :event/even true] [?e ?a ?v] [?e :event/id ?v]])'))
    df = engine.query("(query [:find ?id ?t :any-valid-time :where [?e :event/id ?id] [?e :db/valid-to ?t]])").toDF("id", "ed")
    return df.select(F.col("id")["i"].alias("id"), "ed")
