"""The engine's queries over a graph on the TPC-H-like tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import algo, fts, vector
from .operators.paths import reachable, shortest_paths
from .runtime import shared_dir
from .session import Database, GraphSession
from .sources import rdf, readers
from .streaming.delta import DeltaBatch, merge, stream_into

Query = Callable[[SparkSession, str], DataFrame]


#: Turns of a conversation are numbered within this many.
TURNS_EACH = 1_000_000


def graph(spark: SparkSession, sf_dir: str) -> GraphSession:
    """Region, Nation, Customer, Supplier, Part, Orders, Event, User, Turn, Document and their relationships.

    Tables are registered once for a session and folder, and each is read when a query first names it;
    every call gets a session of its own on them, so changes stay with the caller."""
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _graphs:
        _graphs[known] = _registered(spark, sf_dir)
    return _graphs[known].fork()


_graphs: dict[tuple[str, str], GraphSession] = {}


def _registered(spark: SparkSession, sf_dir: str) -> GraphSession:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    g = GraphSession(spark)
    for label, name, key in (("Region", "region", "r_regionkey"), ("Nation", "nation", "n_nationkey"), ("Customer", "customer", "c_custkey"), ("Supplier", "supplier", "s_suppkey"), ("Part", "part", "p_partkey"), ("Orders", "orders", "o_orderkey"), ("Event", "events", "event_id"), ("Document", "documents", "doc_id")):
        g.lazy_node_table(label, lambda name=name, key=key: t(name).withColumn(key, F.col(key).cast("bigint")), key)
    turns = lambda: t("conversations").select((F.col("conv_id") * TURNS_EACH + F.col("turn")).alias("turn_id"), "conv_id", "turn", "role")
    g.lazy_node_table("User", lambda: t("events").select(F.col("user_id").cast("bigint").alias("user_id")).distinct(), "user_id")
    g.lazy_node_table("Turn", turns, "turn_id")
    g.lazy_rel_table("IN_REGION", lambda: t("nation").select("n_nationkey", "n_regionkey"), "Nation", "Region")
    g.lazy_rel_table("CUST_NATION", lambda: t("customer").select("c_custkey", "c_nationkey"), "Customer", "Nation")
    g.lazy_rel_table("SUPP_NATION", lambda: t("supplier").select("s_suppkey", "s_nationkey"), "Supplier", "Nation")
    g.lazy_rel_table("PLACED", lambda: t("orders").select("o_custkey", "o_orderkey"), "Customer", "Orders")
    g.lazy_rel_table("CONTAINS", lambda: t("lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount")), "Orders", "Part")
    g.lazy_rel_table("SUPPLIES", lambda: t("lineitem").select("l_suppkey", "l_partkey").distinct(), "Supplier", "Part")
    g.lazy_rel_table("DID", lambda: t("events").select("user_id", "event_id"), "User", "Event")
    g.lazy_rel_table("NEXT", lambda: turns().select(F.col("turn_id").alias("a"), (F.col("turn_id") + 1).alias("b")).join(turns().select(F.col("turn_id").alias("b")), "b").select("a", "b"), "Turn", "Turn")
    g.lazy_rel_table("KNOWS", lambda: knows(spark, sf_dir), "Customer", "Customer")
    g.lazy_rel_table("SHIPPED", lambda: t("lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").alias("quantity")), "Orders", "Part")
    return g


def knows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("bigint").alias("a"))
    n = c.count()
    j = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("j")
    return c.select("a", j).select("a", ((F.col("a") * F.col("a") + F.col("j") * F.col("j") * 13 + F.col("j")) % n + 1).alias("b")).filter("a <> b").distinct()


KNOWS = "knows AS (SELECT DISTINCT a, b FROM (SELECT c_custkey AS a, (c_custkey*c_custkey + j*j*13 + j) % (SELECT count(*) FROM customer) + 1 AS b FROM customer, (VALUES (1),(2),(3)) v(j)) x WHERE a <> b)"
TURNS = "turns AS (SELECT conv_id*1000000+turn AS id, conv_id, turn, role FROM conversations), nexts AS (SELECT x.id AS a, y.id AS b FROM turns x JOIN turns y ON y.id = x.id + 1)"

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def add(key: str, query: str | Query, sql: str | None) -> None:
    _queries[key] = query if callable(query) else lambda spark, sf_dir, q=query: graph(spark, sf_dir).execute(q)
    if sql:
        _sql[key] = sql


# -- scans, filters, projections ---------------------------------------------
add("scan_node", "MATCH (c:Customer) RETURN c.c_custkey AS k, c.c_name AS name, c.c_acctbal AS bal", "SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer")
add("scan_rel", "MATCH (:Orders)-[r:CONTAINS]->(:Part) RETURN r.quantity AS q, r.price AS p", "SELECT l_quantity AS q, l_extendedprice AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey")
add("scan_empty", "RETURN 1 AS one, 'x' AS x", "SELECT CAST(1 AS BIGINT) AS one, 'x' AS x")
add("scan_filter_project", "MATCH (c:Customer) WHERE c.c_acctbal > 5000 RETURN c.c_custkey AS k, c.c_name AS name", "SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_acctbal > 5000")
add("pipeline_group", "MATCH (c:Customer) WHERE c.c_acctbal > 0 RETURN c.c_mktsegment AS seg, count(*) AS n ORDER BY seg", "SELECT c_mktsegment AS seg, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
add("filter_3vl", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 200000 WITH c, o WHERE NOT (o.o_totalprice > 300000) OR o.o_orderkey IS NULL RETURN c.c_custkey AS c, o.o_orderkey AS o", "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 WHERE NOT (o_totalprice > 300000) OR o_orderkey IS NULL")
add("filter_inline_props", "MATCH (n:Nation)-[:IN_REGION]->(r:Region {r_name: 'ASIA'}) RETURN n.n_name AS n", "SELECT n_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
add("filter_label", "MATCH (r:Region) WHERE r:Region RETURN r.r_name AS r", "SELECT r_name AS r FROM region")
add("project_node", "MATCH (r:Region) RETURN r", "SELECT {'r_regionkey': CAST(r_regionkey AS BIGINT), 'r_name': r_name} AS r FROM region")
add("with_scope", "MATCH (c:Customer) WITH c.c_nationkey AS nk, c.c_acctbal AS b WHERE b < 0 RETURN nk, b", "SELECT c_nationkey AS nk, c_acctbal AS b FROM customer WHERE c_acctbal < 0")
add("params", lambda s, d: graph(s, d).execute("MATCH (c:Customer) WHERE c.c_acctbal > $low AND c.c_mktsegment IN $seg RETURN c.c_custkey AS k", {"low": 1000, "seg": ["BUILDING", "MACHINERY"]}), "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 1000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")

_EXPRESSIONS = {
    "int_div_mod": ("Part", "p.p_partkey / 7 AS a, p.p_partkey % 7 AS b, -p.p_partkey AS c, (0 - p.p_partkey) / 7 AS d", "p_partkey // 7 AS a, p_partkey % 7 AS b, -p_partkey AS c, (0 - p_partkey) // 7 AS d"),
    "arith": ("Part", "p.p_retailprice * 2 + 1 AS a, p.p_retailprice - p.p_size AS b, p.p_size * 3 AS c, round(p.p_size ^ 2) AS d", "p_retailprice * 2 + 1 AS a, p_retailprice - p_size AS b, CAST(p_size AS BIGINT) * 3 AS c, round(pow(p_size, 2)) AS d"),
    "bits": ("Part", "p.p_partkey & 12 AS a, p.p_partkey | 3 AS b, p.p_partkey << 2 AS c, p.p_partkey >> 1 AS d, ~p.p_partkey AS e", "p_partkey & 12 AS a, p_partkey | 3 AS b, p_partkey << 2 AS c, p_partkey >> 1 AS d, ~p_partkey AS e"),
    "case": ("Part", "CASE WHEN p.p_size > 40 THEN 'big' WHEN p.p_size > 20 THEN 'mid' END AS a, CASE p.p_size WHEN 1 THEN 'one' ELSE 'many' END AS b", "CASE WHEN p_size > 40 THEN 'big' WHEN p_size > 20 THEN 'mid' END AS a, CASE p_size WHEN 1 THEN 'one' ELSE 'many' END AS b"),
    "in": ("Part", "p.p_size IN [1, 5, 9] AS a, p.p_size IN [1, null] AS b, NOT p.p_size IN [1, 2] AS c", "p_size IN (1, 5, 9) AS a, p_size IN (1, NULL) AS b, NOT p_size IN (1, 2) AS c"),
    "chain_cmp": ("Part", "1 < p.p_size < 10 AS a, p.p_size <> 3 AS b, p.p_size >= 30 AS c", "1 < p_size AND p_size < 10 AS a, p_size <> 3 AS b, p_size >= 30 AS c"),
    "logic": ("Part", "p.p_size > 9 AND p.p_size < 20 AS a, p.p_size > 9 OR null AS b, p.p_size > 9 XOR p.p_size > 20 AS c, NOT p.p_size > 9 AS d", "p_size > 9 AND p_size < 20 AS a, p_size > 9 OR NULL AS b, (p_size > 9) <> (p_size > 20) AS c, NOT p_size > 9 AS d"),
    "null": ("Part", "p.p_size IS NULL AS a, p.p_size IS NOT NULL AS b, null = 1 AS c", "p_size IS NULL AS a, p_size IS NOT NULL AS b, CAST(NULL AS BOOLEAN) AS c"),
    "str_predicates": ("Part", "p.p_name STARTS WITH 'a' AS a, p.p_name ENDS WITH 'e' AS b, p.p_name CONTAINS 'in' AS c", "starts_with(p_name, 'a') AS a, suffix(p_name, 'e') AS b, contains(p_name, 'in') AS c"),
    "regex": ("Part", "p.p_brand =~ 'Brand#1.*' AS a, p.p_brand =~ 'rand' AS b", "regexp_full_match(p_brand, 'Brand#1.*') AS a, regexp_full_match(p_brand, 'rand') AS b"),
    "list": ("Part", "[p.p_size, 1, 2][1] AS a, [p.p_size, 1, 2][9] AS b, [p.p_size, 1, 2][0] AS c, size([p.p_size, 1]) AS d", "CAST(p_size AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS BIGINT) AS c, CAST(2 AS BIGINT) AS d"),
    "slice": ("Part", "tostring([p.p_size, 1, 2, 3][2..3]) AS a, size([p.p_size, 1, 2][2..9]) AS b", "'[1,2]' AS a, CAST(2 AS BIGINT) AS b"),
    "comprehension": ("Part", "tostring([x IN [1, 2, p.p_size] WHERE x > 1 | x * 10]) AS a", "'[' || array_to_string(list_transform(list_filter([1, 2, CAST(p_size AS BIGINT)], lambda x: x > 1), lambda x: x * 10), ',') || ']' AS a"),
    "quantifiers": ("Part", "all(x IN [1, p.p_size] WHERE x > 0) AS a, any(x IN [1, p.p_size] WHERE x > 40) AS b, none(x IN [p.p_size] WHERE x > 40) AS c, single(x IN [1, p.p_size] WHERE x > 40) AS d", "p_size > 0 AS a, p_size > 40 AS b, NOT p_size > 40 AS c, p_size > 40 AS d"),
    "map": ("Part", "{a: p.p_size, b: 2}.a AS a, {a: 1}['b'] AS b", "CAST(p_size AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b"),
    "concat_op": ("Part", "p.p_brand + '-' + p.p_size AS a, p.p_brand || '!' AS b", "p_brand || '-' || p_size AS a, p_brand || '!' AS b"),
}
for _k, (_label, _items, _cols) in _EXPRESSIONS.items():
    add(f"expr_{_k}", f"MATCH (p:{_label}) RETURN p.p_partkey AS k, {_items}", f"SELECT p_partkey AS k, {_cols} FROM part")

# -- scalar functions: (query expression, SQL expression) over Part ---------------
_FUNCTIONS = {
    "abs": ("abs(0 - p.p_size) AS v, abs(p.p_retailprice) AS w", "abs(0 - CAST(p_size AS BIGINT)) AS v, abs(p_retailprice) AS w"),
    "floor": ("floor(p.p_retailprice) AS v", "floor(p_retailprice) AS v"),
    "ceil": ("ceil(p.p_retailprice) AS v", "ceil(p_retailprice) AS v"),
    "round": ("round(p.p_retailprice) AS v", "round(p_retailprice) AS v"),
    "sqrt": ("round(sqrt(p.p_retailprice) * 1000000) AS v", "round(sqrt(p_retailprice) * 1000000) AS v"),
    "log": ("round(log(p.p_retailprice) * 1000000) AS v, log(0.0) AS z", "round(ln(p_retailprice) * 1000000) AS v, CAST('-inf' AS DOUBLE) AS z"),
    "log2": ("round(log2(p.p_retailprice) * 1000000) AS v", "round(log2(p_retailprice) * 1000000) AS v"),
    "log10": ("round(log10(p.p_retailprice) * 1000000) AS v", "round(log10(p_retailprice) * 1000000) AS v"),
    "sin": ("round(sin(p.p_size) * 1000000) AS v", "round(sin(p_size) * 1000000) AS v"),
    "cos": ("round(cos(p.p_size) * 1000000) AS v", "round(cos(p_size) * 1000000) AS v"),
    "tan": ("round(tan(p.p_size) * 1000) AS v", "round(tan(p_size) * 1000) AS v"),
    "sign": ("sign(p.p_size - 25) AS v", "CAST(sign(p_size - 25) AS BIGINT) AS v"),
    "greatest": ("greatest(p.p_size, 25, null) AS v, greatest(p.p_size) AS w", "greatest(CAST(p_size AS BIGINT), 25) AS v, p_size AS w"),
    "least": ("least(p.p_size, 25, null) AS v", "least(CAST(p_size AS BIGINT), 25) AS v"),
    "lower": ("lower(p.p_brand) AS v", "lower(p_brand) AS v"),
    "upper": ("upper(p.p_name) AS v", "upper(p_name) AS v"),
    "length": ("length(p.p_name) AS v, length('é' + p.p_brand) AS w", "CAST(strlen(p_name) AS BIGINT) AS v, CAST(strlen('é' || p_brand) AS BIGINT) AS w"),
    "size": ("size([1, p.p_size, null]) AS v, size(p.p_brand) AS w", "CAST(3 AS BIGINT) AS v, CAST(strlen(p_brand) AS BIGINT) AS w"),
    "trim": ("trim('  ' + p.p_brand + ' ') AS v", "p_brand AS v"),
    "ltrim": ("ltrim('  ' + p.p_brand + ' ') AS v", "p_brand || ' ' AS v"),
    "rtrim": ("rtrim('  ' + p.p_brand + ' ') AS v", "'  ' || p_brand AS v"),
    "reverse": ("reverse(p.p_brand) AS v", "reverse(p_brand) AS v"),
    "substring": ("substring(p.p_name, 2, 3) AS v, substring(p.p_name, 0, 2) AS w, substring(p.p_name, -1, 2) AS x", "substring(p_name, 2, 3) AS v, substring(p_name, 1, 2) AS w, '' AS x"),
    "left": ("left(p.p_name, 3) AS v", "left(p_name, 3) AS v"),
    "right": ("right(p.p_name, 3) AS v", "right(p_name, 3) AS v"),
    "replace": ("replace(p.p_brand, 'Brand', 'B') AS v", "replace(p_brand, 'Brand', 'B') AS v"),
    "concat": ("concat(p.p_brand, '-', p.p_size) AS v, concat(p.p_brand, null) AS w", "p_brand || '-' || p_size AS v, CAST(NULL AS VARCHAR) AS w"),
    "lpad": ("lpad(p.p_brand, 12, '*') AS v, lpad(p.p_brand, 3, '*') AS w, lpad('x', 6, 'ab') AS x", "CASE WHEN strlen(p_brand) >= 12 THEN p_brand ELSE lpad(p_brand, 12, '*') END AS v, p_brand AS w, 'aababx' AS x"),
    "rpad": ("rpad(p.p_brand, 12, '*') AS v, rpad(p.p_brand, 3, '*') AS w", "CASE WHEN strlen(p_brand) >= 12 THEN p_brand ELSE rpad(p_brand, 12, '*') END AS v, p_brand AS w"),
    "tostring": ("tostring(p.p_size) AS v, tostring(2.0) AS w, tostring(true) AS x, tostring([1, 2]) AS y", "CAST(p_size AS VARCHAR) AS v, '2' AS w, 'true' AS x, '[1,2]' AS y"),
    "tointeger": ("tointeger(p.p_retailprice) AS v, tointeger(tostring(p.p_size)) AS w, tointeger(p.p_size > 9) AS x", "CAST(trunc(p_retailprice) AS BIGINT) AS v, CAST(p_size AS BIGINT) AS w, CAST(p_size > 9 AS BIGINT) AS x"),
    "tofloat": ("tofloat(p.p_size) AS v, tofloat('2.5') AS w", "CAST(p_size AS DOUBLE) AS v, CAST(2.5 AS DOUBLE) AS w"),
    "toboolean": ("toboolean(p.p_size - 1) AS v, toboolean('TRUE') AS w", "p_size <> 1 AS v, TRUE AS w"),
    "coalesce": ("coalesce(null, p.p_size, 3) AS v", "CAST(p_size AS BIGINT) AS v"),
    "typeof": ("typeof(p.p_partkey) AS v, typeof(p.p_name) AS w, typeof(p.p_retailprice) AS x, typeof(null) AS y, typeof([1]) AS z", "'INT64' AS v, 'STRING' AS w, 'DOUBLE' AS x, 'NULL' AS y, 'LIST' AS z"),
    "hash": ("hash(p.p_name) = hash(p.p_name) AS v, hash(null) AS w", "TRUE AS v, CAST(NULL AS BIGINT) AS w"),
    "range": ("size(range(1, p.p_size)) AS v, size(range(3, 1)) AS w", "CAST(p_size AS BIGINT) AS v, CAST(0 AS BIGINT) AS w"),
}
for _k, (_items, _cols) in _FUNCTIONS.items():
    add(f"fn_{_k}", f"MATCH (p:Part) RETURN p.p_partkey AS k, {_items}", f"SELECT p_partkey AS k, {_cols} FROM part")
add("fn_env", lambda s, d: graph(s, d).execute("MATCH (r:Region) RETURN r.r_name AS r, env('HOME_X') AS v, env('NONE_X') IS NULL AS w", env={"HOME_X": "here"}), "SELECT r_name AS r, 'here' AS v, TRUE AS w FROM region")
_JSON = {
    "extract": ("json_extract(e.props, '$.k') AS v, json_extract('{\"a\": {\"b\": [1, 20]}}', 'a.b.1') AS w, json_extract(e.props, 'zz') AS x", "json_extract_string(props, '$.k') AS v, '20' AS w, CAST(NULL AS VARCHAR) AS x"),
    "valid": ("json_valid(e.props) AS v, json_valid('{') AS w", "json_valid(props) AS v, FALSE AS w"),
    "type": ("json_type(e.props) AS v, json_type('[1]') AS w", "'object' AS v, 'array' AS w"),
    "keys": ("json_keys(e.props)[1] AS v, json_keys('[1]') IS NULL AS w", "json_keys(props)[1] AS v, TRUE AS w"),
    "array_length": ("json_array_length('[1, 2]') AS v, json_array_length(e.props) IS NULL AS w", "CAST(2 AS BIGINT) AS v, TRUE AS w"),
    "contains": ("json_contains(e.props, '$.k') AS v, json_contains(e.props, '$.zz') AS w", "json_extract(props, '$.k') IS NOT NULL AS v, FALSE AS w"),
    "set": ("json_extract(json_set(e.props, '$.n', '5'), '$.n') AS v", "'5' AS v"),
}
for _k, (_items, _cols) in _JSON.items():
    add(f"fn_json_{_k}", f"MATCH (e:Event) RETURN e.event_id AS k, {_items}", f"SELECT event_id AS k, {_cols} FROM events")

# -- aggregation ---------------------------------------------------------------------
add("agg_group", "MATCH (c:Customer) RETURN c.c_mktsegment AS seg, count(*) AS n, round(sum(c.c_acctbal)) AS s, round(avg(c.c_acctbal) * 100) AS a, min(c.c_acctbal) AS lo, max(c.c_name) AS hi", "SELECT c_mktsegment AS seg, count(*) AS n, round(sum(c_acctbal)) AS s, round(avg(c_acctbal) * 100) AS a, min(c_acctbal) AS lo, max(c_name) AS hi FROM customer GROUP BY 1")
add("agg_global", "MATCH (o:Orders) RETURN count(*) AS n, sum(o.o_custkey) AS s", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders")
add("agg_empty", "MATCH (c:Customer) WHERE false RETURN count(*) AS n, sum(c.c_custkey) AS s, avg(c.c_acctbal) AS a", "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS s, CAST(NULL AS DOUBLE) AS a")
add("agg_count_null", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Orders) RETURN c.c_custkey AS k, count(o.o_orderkey) AS n", "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
add("agg_distinct", "MATCH (o:Orders) RETURN o.o_orderstatus AS s, count(DISTINCT o.o_custkey) AS n, sum(DISTINCT o.o_custkey) AS t", "SELECT o_orderstatus AS s, count(DISTINCT o_custkey) AS n, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS t FROM orders GROUP BY 1")
add("agg_collect", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS r, size(collect(n.n_name)) AS n, size(collect(DISTINCT n.n_name)) AS d", "SELECT r_name AS r, count(*) AS n, count(DISTINCT n_name) AS d FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
add("agg_collect_nulls", "UNWIND [1, null, 2] AS x RETURN size(collect(x)) AS n, count(x) AS c", "SELECT CAST(3 AS BIGINT) AS n, CAST(2 AS BIGINT) AS c")
add("agg_nested", "MATCH (c:Customer) RETURN c.c_mktsegment AS seg, count(*) + 1 AS n, max(c.c_custkey) - min(c.c_custkey) AS d", "SELECT c_mktsegment AS seg, count(*) + 1 AS n, max(c_custkey) - min(c_custkey) AS d FROM customer GROUP BY 1")
add("agg_having", "MATCH (c:Customer) WITH c.c_nationkey AS nk, count(*) AS n WHERE n > 50 RETURN nk, n", "SELECT c_nationkey AS nk, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 50")
add("distinct", "MATCH (o:Orders) RETURN DISTINCT o.o_orderstatus AS s, o.o_orderpriority AS p", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders")

# -- patterns ------------------------------------------------------------------------
add("join_1hop", "MATCH (c:Customer)-[:CUST_NATION]->(n:Nation) RETURN c.c_custkey AS c, n.n_name AS n", "SELECT c_custkey AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey")
add("join_2hop", "MATCH (c:Customer)-[:CUST_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS r, count(*) AS k", "SELECT r_name AS r, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
add("join_3hop", "MATCH (o:Orders)<-[:PLACED]-(c:Customer)-[:CUST_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS r, count(*) AS k, round(sum(o.o_totalprice)) AS s", "SELECT r_name AS r, count(*) AS k, round(sum(o_totalprice)) AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
add("join_left_dir", "MATCH (n:Nation)<-[:CUST_NATION]-(c:Customer) RETURN n.n_name AS n, count(*) AS k", "SELECT n_name AS n, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
add("join_both_dir", "MATCH (a:Customer)-[:KNOWS]-(b:Customer) RETURN a.c_custkey AS a, count(*) AS n", f"WITH {KNOWS}, k AS (SELECT a, b FROM knows JOIN customer ON c_custkey = b) SELECT a, count(*) AS n FROM (SELECT a, b FROM k UNION ALL SELECT b, a FROM k) x GROUP BY 1")
add("join_rel_props", "MATCH (o:Orders)-[r:CONTAINS]->(p:Part) WHERE r.quantity > 45 RETURN p.p_brand AS b, round(sum(r.price)) AS s", "SELECT p_brand AS b, round(sum(l_extendedprice)) AS s FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 45 GROUP BY 1")
add("join_rel_inline", "MATCH (o:Orders)-[:CONTAINS {quantity: 10.0}]->(p:Part) RETURN count(*) AS n", "SELECT count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity = 10")
add("join_cycle", "MATCH (a:Customer)-[:KNOWS]->(b:Customer)-[:KNOWS]->(a) RETURN a.c_custkey AS a, b.c_custkey AS b", f"WITH {KNOWS} SELECT x.a, x.b FROM knows x JOIN knows y ON x.b = y.a AND y.b = x.a")
add("join_optional", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 300000 RETURN c.c_custkey AS c, o.o_orderkey AS o", "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000")
add("join_alternatives", "MATCH (x)-[:SUPP_NATION]->(n:Nation) RETURN n.n_name AS n, count(*) AS k", "SELECT n_name AS n, count(*) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
add("join_rel_union", "MATCH (a:Customer)-[:KNOWS|KNOWS]->(b:Customer) RETURN count(*) AS n", f"WITH {KNOWS} SELECT 2 * count(*) AS n FROM knows JOIN customer ON c_custkey = b")
add("join_two_types", "MATCH (o:Orders)-[r:SHIPPED|CONTAINS]->(:Part) RETURN o.o_orderkey AS o, count(*) AS n, round(sum(r.quantity)) AS q, count(r.price) AS p", "SELECT o_orderkey AS o, 2 * count(*) AS n, round(2 * sum(l_quantity)) AS q, count(*) AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
add("optional_rel_var", "MATCH (o:Orders)-[r:CONTAINS]->(p:Part) OPTIONAL MATCH (o)-[s:SHIPPED]->(x:Part) WHERE s.quantity < r.quantity RETURN o.o_orderkey AS o, r.quantity AS q, count(x.p_partkey) AS n", "SELECT o, q, count(s.l_quantity) AS n FROM (SELECT l_orderkey AS o, l_quantity AS q FROM lineitem) r LEFT JOIN lineitem s ON s.l_orderkey = r.o AND s.l_quantity < r.q GROUP BY 1, 2")
add("exists_rel_var", "MATCH (o:Orders)-[r:CONTAINS]->(p:Part) WHERE EXISTS { MATCH (o)-[s:SHIPPED]->(x:Part) WHERE s.quantity > r.quantity } RETURN o.o_orderkey AS o, p.p_partkey AS p, r.quantity AS q", "SELECT l_orderkey AS o, l_partkey AS p, l_quantity AS q FROM lineitem r WHERE EXISTS (SELECT 1 FROM lineitem s WHERE s.l_orderkey = r.l_orderkey AND s.l_quantity > r.l_quantity)")
add("count_rel_var", "MATCH (o:Orders)-[r:CONTAINS]->(p:Part) RETURN o.o_orderkey AS o, r.quantity AS q, COUNT { MATCH (o)-[s:SHIPPED]->(x:Part) WHERE s.quantity > r.quantity } AS n", "SELECT l_orderkey AS o, l_quantity AS q, (SELECT count(*) FROM lineitem s WHERE s.l_orderkey = r.l_orderkey AND s.l_quantity > r.l_quantity) AS n FROM lineitem r")
add("exists_or", "MATCH (c:Customer) WHERE c.c_acctbal < 0 OR EXISTS { MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 400000 } RETURN c.c_custkey AS c, EXISTS { MATCH (c)-[:PLACED]->(o:Orders) } AS e", "SELECT c_custkey AS c, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS e FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
add("join_labels", "MATCH (c:Customer:Nation) RETURN count(*) AS n", "SELECT count(*) AS n FROM customer")
add("join_comma", "MATCH (a:Region), (b:Region) WHERE a.r_regionkey < b.r_regionkey RETURN a.r_name AS a, b.r_name AS b", "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b WHERE a.r_regionkey < b.r_regionkey")
add("join_comma_shared", "MATCH (c:Customer)-[:CUST_NATION]->(n:Nation), (s:Supplier)-[:SUPP_NATION]->(n) RETURN n.n_name AS n, count(*) AS k", "SELECT n_name AS n, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
add("join_multi_match", "MATCH (r:Region {r_name: 'EUROPE'}) MATCH (n:Nation)-[:IN_REGION]->(r) RETURN n.n_name AS n", "SELECT n_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'")
add("join_exists", "MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 400000 } RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
add("join_not_exists", "MATCH (c:Customer) WHERE NOT EXISTS { MATCH (c)-[:PLACED]->(o:Orders) } RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
add("join_count_sub", "MATCH (n:Nation) RETURN n.n_name AS n, COUNT { (n)<-[:SUPP_NATION]-(s:Supplier) } AS k", "SELECT n_name AS n, count(s_suppkey) AS k FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
add("path_value", "MATCH p = (n:Nation)-[:IN_REGION]->(r:Region) RETURN tostring(p) AS p", "SELECT '[' || n_nationkey || ',' || n_regionkey || ']' AS p FROM nation")

_REACH = "reach AS (SELECT a AS src, b AS dst, 1 AS d FROM {e} WHERE {w} UNION SELECT r.src, e.b, r.d + 1 FROM reach r JOIN {e} e ON r.dst = e.a WHERE r.d < {high}), firsts AS (SELECT src, dst, min(d) AS d FROM reach WHERE src <> dst GROUP BY 1, 2)"


def _varlen(key: str, hops: str, low: int, high: int, arrow: str = "->") -> None:
    left, right = {"->": ("-", "->"), "<-": ("<-", "-"), "--": ("-", "-")}[arrow]
    e = {"->": "knows", "<-": "(SELECT b AS a, a AS b FROM knows)", "--": "(SELECT a, b FROM knows UNION SELECT b, a FROM knows)"}[arrow]
    extra = "" if e == "knows" else f", walked AS {e}"
    name = "knows" if e == "knows" else "walked"
    add(
        key,
        f"MATCH (a:Customer){left}[:KNOWS{hops}]{right}(b:Customer) RETURN a.c_custkey AS a, count(*) AS n",
        f"WITH RECURSIVE {KNOWS}{extra}, {_REACH.format(e=name, w='TRUE', high=high)} SELECT src AS a, count(*) AS n FROM firsts JOIN customer ON c_custkey = dst WHERE d >= {low} GROUP BY 1",
    )


_varlen("varlen_1_2", "*1..2", 1, 2)
_varlen("varlen_1_3", "*1..3", 1, 3)
_varlen("varlen_min2", "*2..3", 2, 3)
_varlen("varlen_left", "*1..2", 1, 2, arrow="<-")
_varlen("varlen_both", "*1..2", 1, 2, arrow="--")
_varlen("varlen_fixed", "*2", 2, 2)
add("varlen_chain", "MATCH (a:Turn)-[:NEXT*]->(b:Turn) WHERE a.turn = 0 RETURN a.turn_id AS a, count(*) AS n", f"WITH RECURSIVE {TURNS}, {_REACH.format(e='nexts', w='a % 1000000 = 0', high=30)} SELECT src AS a, count(*) AS n FROM firsts GROUP BY 1")
_SHORTEST = f"WITH RECURSIVE {KNOWS}, {_REACH.format(e='knows', w='TRUE', high=4)} "
add("varlen_filtered", "MATCH (a:Customer)-[:KNOWS*1..4]->(b:Customer) WHERE a.c_acctbal < -900 AND b.c_acctbal > 0 RETURN a.c_custkey AS a, b.c_custkey AS b", _SHORTEST + "SELECT src AS a, dst AS b FROM firsts JOIN customer x ON x.c_custkey = src JOIN customer y ON y.c_custkey = dst WHERE x.c_acctbal < -900 AND y.c_acctbal > 0")
add("shortest_path", "MATCH p = shortestPath((a:Customer)-[:KNOWS*1..4]->(b:Customer)) RETURN a.c_custkey AS a, b.c_custkey AS b, size(p) - 1 AS d", _SHORTEST + "SELECT src AS a, dst AS b, d FROM firsts JOIN customer ON c_custkey = dst WHERE d <= 4")
add("shortest_path_ends", "MATCH p = shortestPath((a:Customer)-[:KNOWS*1..4]->(b:Customer)) WHERE a.c_acctbal < 0 AND b.c_acctbal > 9000 RETURN a.c_custkey AS a, b.c_custkey AS b, size(p) - 1 AS d", _SHORTEST + "SELECT src AS a, dst AS b, d FROM firsts JOIN customer x ON x.c_custkey = src JOIN customer y ON y.c_custkey = dst WHERE x.c_acctbal < 0 AND y.c_acctbal > 9000")
add(
    "shortest_path_pairs",
    lambda s, d: (lambda e: shortest_paths(e, e.select(F.col("_dst").alias("_src"), F.col("_src").alias("_dst")), 4).select(F.col("_src").alias("a"), F.col("_dst").alias("b"), (F.size("_path") - 1).cast("bigint").alias("d")))(graph(s, d).catalog.need("KNOWS").df),
    _SHORTEST + "SELECT x.b AS a, x.a AS b, coalesce(d, -1) AS d FROM knows x LEFT JOIN firsts ON src = x.b AND dst = x.a",
)
add("reachable_api", lambda s, d: reachable(graph(s, d).catalog.need("NEXT").df, None, 1, 30).select(F.col("_src").alias("a"), F.col("_dst").alias("b"), F.col("_depth").alias("d")), f"WITH RECURSIVE {TURNS}, {_REACH.format(e='nexts', w='TRUE', high=30)} SELECT src AS a, dst AS b, d FROM firsts")

# -- unwind, sort, limit, set operations --------------------------------------------------
add("unwind_list", "UNWIND [3, 1, null, 2] AS x RETURN x", "SELECT CAST(x AS BIGINT) AS x FROM (VALUES (3), (1), (NULL), (2)) v(x)")
add("unwind_range", "UNWIND range(1, 5) AS i RETURN i, i * i AS q", "SELECT i, i * i AS q FROM range(1, 6) t(i)")
add("unwind_match", "MATCH (r:Region) UNWIND [1, 2] AS x RETURN r.r_name AS r, x", "SELECT r_name AS r, CAST(x AS BIGINT) AS x FROM region, (VALUES (1), (2)) v(x)")
add("unwind_empty", "UNWIND [] AS x RETURN count(*) AS n", "SELECT CAST(0 AS BIGINT) AS n")
add("sort_limit", "MATCH (c:Customer) RETURN c.c_custkey AS k, c.c_acctbal AS b ORDER BY b DESC, k LIMIT 7", "SELECT c_custkey AS k, c_acctbal AS b FROM customer ORDER BY b DESC, k LIMIT 7")
add("sort_nulls", "MATCH (c:Customer) RETURN c.c_custkey AS k, CASE WHEN c.c_acctbal > 0 THEN c.c_acctbal END AS b ORDER BY b DESC, k LIMIT 5", "SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS b FROM customer ORDER BY b DESC NULLS FIRST, k LIMIT 5")
add("sort_other_column", "MATCH (c:Customer) RETURN c.c_name AS n ORDER BY c.c_acctbal, c.c_custkey LIMIT 5", "SELECT c_name AS n FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5")
add("skip_limit", "MATCH (c:Customer) RETURN c.c_custkey AS k ORDER BY k SKIP 10 LIMIT 5", "SELECT c_custkey AS k FROM customer ORDER BY k LIMIT 5 OFFSET 10")
add("union", "MATCH (r:Region) RETURN r.r_name AS n UNION MATCH (r:Region) RETURN r.r_name AS n", "SELECT r_name AS n FROM region")
add("union_all", "MATCH (r:Region) RETURN r.r_name AS n UNION ALL MATCH (n:Nation) RETURN n.n_name AS n", "SELECT r_name AS n FROM region UNION ALL SELECT n_name FROM nation")

# -- procedures ------------------------------------------------------------------------
_ROUND = "r{k} AS (SELECT n.v, 0.15 / c.n + 0.85 * coalesce((SELECT sum(r) FROM r{p} WHERE v NOT IN (SELECT a FROM knows)), 0) / c.n + 0.85 * coalesce(i.s, 0) AS r FROM nodes n CROSS JOIN cnt c LEFT JOIN (SELECT e.b, sum(x.r / o.d) AS s FROM knows e JOIN r{p} x ON x.v = e.a JOIN outs o ON o.a = e.a GROUP BY 1) i ON i.b = n.v)"
add(
    "algo_pagerank",
    lambda s, d: algo.pagerank(algo.edges_of(graph(s, d), "KNOWS"), 0.85, 5, 0.0).select("node_id", F.round(F.col("rank") * 1e9).alias("rank")),
    f"WITH {KNOWS}, nodes AS (SELECT a AS v FROM knows UNION SELECT b FROM knows), cnt AS (SELECT count(*) AS n FROM nodes), outs AS (SELECT a, count(*) AS d FROM knows GROUP BY 1), r0 AS (SELECT v, 1.0::DOUBLE / (SELECT n FROM cnt) AS r FROM nodes), " + ", ".join(_ROUND.format(k=k, p=k - 1) for k in range(1, 6)) + " SELECT v AS node_id, round(r * 1e9) AS rank FROM r5",
)
add("algo_wcc", lambda s, d: algo.components(algo.edges_of(graph(s, d), "NEXT")), f"WITH {TURNS}, g AS (SELECT id, conv_id FROM turns WHERE id IN (SELECT a FROM nexts UNION SELECT b FROM nexts)), m AS (SELECT id, id - row_number() OVER (PARTITION BY conv_id ORDER BY id) AS isl, conv_id FROM (SELECT DISTINCT id, conv_id FROM g) x) SELECT id AS node_id, min(id) OVER (PARTITION BY conv_id, isl) AS component FROM m")
add("algo_betweenness", lambda s, d: algo.betweenness(algo.edges_of(graph(s, d), "KNOWS")).select("node_id", F.round("centrality", 6).alias("centrality")), None)
add("call_pagerank", "CALL algo.pageRank(0.85, 5, 0, rel = 'KNOWS') YIELD node_id AS id, rank RETURN id, round(rank * 1000000000.0) AS rank", _sql["algo_pagerank"].replace("v AS node_id", "v AS id"))
add(
    "vector_l2",
    lambda s, d: vector.nearest(_vectors(s, d), list(_vectors(s, d).filter("id = 0").first()["vector"]), 10).select("id", F.round("distance", 6).alias("distance")),
    "SELECT vec_id AS id, round(list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0)), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), 6) AS distance FROM embeddings ORDER BY distance, id LIMIT 10",
)
add(
    "vector_cosine",
    lambda s, d: vector.nearest(_vectors(s, d), list(_vectors(s, d).filter("id = 0").first()["vector"]), 10, "cosine").select("id", F.round("distance", 6).alias("distance")),
    "SELECT vec_id AS id, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 6) AS distance FROM embeddings ORDER BY distance, id LIMIT 10",
)
add(
    "vector_each",
    lambda s, d: vector.nearest_each(_vectors(s, d), _vectors(s, d).filter("id % 50 = 0"), 5).select("query_id", "rank", F.round("distance", 5).alias("distance")),
    "WITH d AS (SELECT q.vec_id AS query_id, list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS distance, v.vec_id AS id FROM embeddings v JOIN embeddings q ON q.vec_id % 50 = 0) SELECT query_id, rank, round(distance, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d) x WHERE rank <= 5",
)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


add(
    "fts_bm25",
    lambda s, d: fts.bm25(s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("text").alias("content")), "stupid clown", 10).select("doc_id", F.round("score", 6).alias("score")),
    """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '' AND strlen(w) <= 40) AS w FROM documents),
f AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'clown')) AS a, len(list_filter(w, lambda x: x = 'stupid')) AS b FROM t),
s AS (SELECT count(*) AS n, avg(n) AS avg, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM f)
SELECT doc_id, round(ln(1 + (s.n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * f.n / avg)) + ln(1 + (s.n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * f.n / avg)), 6) AS score
FROM f, s WHERE a > 0 OR b > 0 ORDER BY score DESC, doc_id LIMIT 10""",
)

# -- changes: statements, then what is left ----------------------------------------------


def after(*statements: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = graph(spark, sf_dir)
        for s in statements[:-1]:
            g.execute(s)
        return g.execute(statements[-1])

    return run


add("ddl_create", after("CREATE NODE TABLE T (a INT64, b STRING DEFAULT 'd', PRIMARY KEY (a))", "CREATE NODE TABLE IF NOT EXISTS T (a INT64, PRIMARY KEY (a))", "CREATE REL TABLE R (FROM T TO T, w DOUBLE)", "CREATE (x:T {a: 1}), (y:T {a: 2, b: 'z'})", "MATCH (x:T {a: 1}), (y:T {a: 2}) CREATE (x)-[:R {w: 1.5}]->(y)", "MATCH (x:T)-[r:R]->(y:T) RETURN x.b AS x, r.w AS w, y.b AS y"), "SELECT 'd' AS x, CAST(1.5 AS DOUBLE) AS w, 'z' AS y")
add("ddl_alter", after("ALTER TABLE Region ADD COLUMN note STRING DEFAULT 'n'", "ALTER TABLE Region RENAME COLUMN note TO remark", "ALTER TABLE Region RENAME TO Area", "MATCH (n:Nation)-[:IN_REGION]->(a:Area) RETURN a.r_name AS r, a.remark AS m, count(*) AS n"), "SELECT r_name AS r, 'n' AS m, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
add("dml_create", after("CREATE (r:Region {r_regionkey: 99, r_name: 'MOON'})", "MATCH (r:Region) RETURN r.r_regionkey AS k, r.r_name AS n"), "SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS n FROM region UNION ALL SELECT 99, 'MOON'")
add("dml_create_rel", after("MATCH (c:Customer)-[:CUST_NATION]->(n:Nation) WHERE c.c_acctbal < -900 MATCH (s:Supplier)-[:SUPP_NATION]->(n) WHERE s.s_acctbal > 0 MATCH (b:Customer {c_custkey: 6}) CREATE (c)-[:KNOWS]->(b)", "MATCH (a:Customer)-[:KNOWS]->(b:Customer) RETURN b.c_custkey AS b, count(*) AS n"), f"WITH {KNOWS} SELECT b, count(*) AS n FROM (SELECT b FROM knows JOIN customer ON c_custkey = b UNION ALL SELECT 6 FROM customer JOIN supplier ON s_nationkey = c_nationkey WHERE c_acctbal < -900 AND s_acctbal > 0) x GROUP BY 1")
add("dml_set", after("MATCH (c:Customer) WHERE c.c_acctbal < 0 SET c.c_acctbal = c.c_acctbal * 2, c.c_mktsegment = 'DEBT'", "MATCH (c:Customer) RETURN c.c_custkey AS k, c.c_acctbal AS b, c.c_mktsegment AS s"), "SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN c_acctbal * 2 ELSE c_acctbal END AS b, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS s FROM customer")
add("dml_delete", after("MATCH (c:Customer)-[k:KNOWS]->(d:Customer) WHERE c.c_acctbal > 0 DELETE k", "MATCH (a:Customer)-[:KNOWS]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b"), f"WITH {KNOWS} SELECT a, b FROM knows JOIN customer x ON x.c_custkey = a JOIN customer y ON y.c_custkey = b WHERE x.c_acctbal <= 0")
add("dml_delete_left", after("MATCH (d:Customer)<-[k:KNOWS]-(c:Customer) WHERE c.c_acctbal > 0 DELETE k", "MATCH (a:Customer)-[:KNOWS]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b"), _sql["dml_delete"])
add("dml_delete_both", after("MATCH (a:Customer)-[k:KNOWS]-(b:Customer) WHERE a.c_acctbal > 0 DELETE k", "MATCH (a:Customer)-[:KNOWS]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b"), f"WITH {KNOWS} SELECT a, b FROM knows JOIN customer x ON x.c_custkey = a JOIN customer y ON y.c_custkey = b WHERE x.c_acctbal <= 0 AND y.c_acctbal <= 0")
add("dml_delete_parallel", after("MATCH (o:Orders)-[r:CONTAINS]->(p:Part) WHERE r.quantity > 10 DELETE r", "MATCH (o:Orders)-[r:CONTAINS]->(p:Part) RETURN o.o_orderkey AS o, p.p_partkey AS p, r.quantity AS q"), "SELECT l_orderkey AS o, l_partkey AS p, l_quantity AS q FROM lineitem WHERE l_quantity <= 10")
add("dml_set_left", after("MATCH (p:Part) WHERE p.p_size > 25 MATCH (p)<-[r:CONTAINS]-(o:Orders) WHERE r.quantity > 20 SET r.quantity = r.quantity + p.p_size, r.price = 0", "MATCH (o:Orders)-[r:CONTAINS]->(p:Part) RETURN o.o_orderkey AS o, p.p_partkey AS p, r.quantity AS q, r.price AS r"), "SELECT l_orderkey AS o, l_partkey AS p, CASE WHEN p_size > 25 AND l_quantity > 20 THEN l_quantity + p_size ELSE l_quantity END AS q, CASE WHEN p_size > 25 AND l_quantity > 20 THEN 0 ELSE l_extendedprice END AS r FROM lineitem JOIN part ON p_partkey = l_partkey")
add("dml_set_types", after("MATCH (o:Orders)-[r:SHIPPED|CONTAINS]->(:Part) WHERE r.quantity > 40 SET r.quantity = 0", "MATCH (o:Orders)-[r:SHIPPED|CONTAINS]->(:Part) RETURN o.o_orderkey AS o, sum(r.quantity) AS q"), "SELECT l_orderkey AS o, sum(2 * CASE WHEN l_quantity > 40 THEN 0 ELSE l_quantity END) AS q FROM lineitem GROUP BY 1")
add("dml_detach_delete", after("MATCH (c:Customer) WHERE c.c_acctbal < 0 DETACH DELETE c", "MATCH (c:Customer)-[:KNOWS]->(d:Customer) RETURN c.c_custkey AS a, d.c_custkey AS b"), f"WITH {KNOWS} SELECT a, b FROM knows JOIN customer x ON x.c_custkey = a JOIN customer y ON y.c_custkey = b WHERE x.c_acctbal >= 0 AND y.c_acctbal >= 0")
add("dml_merge", after("UNWIND [1, 777] AS k MERGE (r:Region {r_regionkey: k}) ON CREATE SET r.r_name = 'NEW' ON MATCH SET r.r_name = 'OLD'", "MATCH (r:Region) RETURN r.r_regionkey AS k, r.r_name AS n"), "SELECT CAST(r_regionkey AS BIGINT) AS k, CASE WHEN r_regionkey = 1 THEN 'OLD' ELSE r_name END AS n FROM region UNION ALL SELECT 777, 'NEW'")
add("dml_merge_rel", after("MATCH (a:Customer)-[:KNOWS]->(b:Customer) MERGE (b)-[:KNOWS]->(a)", "MATCH (a:Customer)-[:KNOWS]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b"), f"WITH {KNOWS}, k AS (SELECT a, b FROM knows JOIN customer ON c_custkey = b) SELECT a, b FROM k UNION SELECT b, a FROM k")
add("txn_rollback", after("BEGIN TRANSACTION", "MATCH (c:Customer) SET c.c_name = 'x'", "ROLLBACK", "MATCH (c:Customer) RETURN c.c_custkey AS k, c.c_name AS n"), "SELECT c_custkey AS k, c_name AS n FROM customer")
add("macro", after("CREATE MACRO plus(a, b) AS a + b * 2", "MATCH (p:Part) RETURN p.p_partkey AS k, plus(p.p_size, 1) AS v"), "SELECT p_partkey AS k, p_size + 2 AS v FROM part")


def _delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order changes its customer's balance; then customers whose balance was below zero go."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    none = lambda c, kind: (F.lit(None).cast(kind).alias(c), F.lit(False).alias(f"_has_{c}"))
    rest = (*none("c_name", "string"), *none("c_nationkey", "int"), *none("c_mktsegment", "string"))
    up = t("orders").select(F.col("o_custkey").alias("c_custkey"), F.lit("upsert").alias("_op"), F.col("o_orderkey").alias("_at"), F.col("o_totalprice").alias("c_acctbal"), F.lit(True).alias("_has_c_acctbal"), *rest)
    gone = t("customer").filter("c_acctbal < 0").select("c_custkey", F.lit("delete").alias("_op"), F.lit(1 << 60).alias("_at"), F.lit(None).cast("double").alias("c_acctbal"), F.lit(False).alias("_has_c_acctbal"), *rest)
    return merge(t("customer"), ["c_custkey"], up.unionByName(gone), counts=False)[0].select("c_custkey", "c_name", "c_acctbal")


add("delta_merge", _delta, "WITH last AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS p FROM orders GROUP BY 1) SELECT coalesce(c_custkey, o_custkey) AS c_custkey, c_name, coalesce(p, c_acctbal) AS c_acctbal FROM customer FULL JOIN last ON o_custkey = c_custkey WHERE c_acctbal >= 0 OR c_custkey IS NULL")


def _batch(what: str) -> Query:
    """A batch on Nation and IN_REGION, then nodes or edges as they are after it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = graph(spark, sf_dir)
        batch = DeltaBatch().upsert_node("Nation", 3, n_name="THREE").upsert_node("Nation", 99, n_name="NEW").upsert_edge(99, "IN_REGION", 1)
        batch.upsert_edge(5, "IN_REGION", 2).delete_node("Nation", 5).delete_node("Nation", 6).upsert_node("Nation", 6, n_name="SIX").upsert_edge(6, "IN_REGION", 0)
        batch.delete_edge(7, "IN_REGION", 3).delete_node("Nation", 98).upsert_edge(98, "IN_REGION", 4)
        g.apply_delta(batch)
        if what == "nodes":
            return g.execute("MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name, n.n_regionkey AS r")
        return g.catalog.need("IN_REGION").df.select(F.col("_src").alias("a"), F.col("_dst").alias("b"))

    return run


add("apply_delta_nodes", _batch("nodes"), "SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey = 3 THEN 'THREE' ELSE n_name END AS name, n_regionkey AS r FROM nation WHERE n_nationkey NOT IN (5, 6) UNION ALL VALUES (99, 'NEW', NULL), (6, 'SIX', NULL)")
add("apply_delta_edges", _batch("edges"), "SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(n_regionkey AS BIGINT) AS b FROM nation WHERE n_nationkey NOT IN (5, 6) AND NOT (n_nationkey = 7 AND n_regionkey = 3) UNION ALL VALUES (99, 1), (6, 0), (98, 4)")


def _scratch(spark: SparkSession, ending: str) -> str:
    return f"{shared_dir(spark)}/weft-copy-{uuid.uuid4().hex}.{ending}"


def _rows_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    g.insert_row("Region", [77, "SEVEN"])
    g.insert_row("Region", {"r_regionkey": 78})
    g.update_cell("Region", 1, "r_name", "ONE")
    g.delete_row("Region", 2)
    return g.execute("MATCH (r:Region) RETURN r.r_regionkey AS k, r.r_name AS n")


add("rows_api", _rows_api, "SELECT CAST(r_regionkey AS BIGINT) AS k, CASE WHEN r_regionkey = 1 THEN 'ONE' ELSE r_name END AS n FROM region WHERE r_regionkey <> 2 UNION ALL VALUES (77, 'SEVEN'), (78, NULL)")


def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, small = GraphSession(spark), graph(spark, sf_dir)
    for name in ("Region", "Nation", "IN_REGION"):
        g.catalog.put(small.catalog.need(name))
    path = _scratch(spark, "db")
    g.save(path)
    again = GraphSession.open(spark, path)
    again.execute("CHECKPOINT")
    return again.execute("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name AS n, r.r_name AS r")


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, g = _scratch(spark, "db"), GraphSession(spark)
    g.catalog.put(graph(spark, sf_dir).catalog.need("Region"))
    g.execute(f"EXPORT DATABASE '{path}'")
    db = Database(spark, path)
    db.connect().execute("MATCH (r:Region) WHERE r.r_name > 'B' SET r.r_name = 'later'")
    db.save()  # a second version, of tables that come from the first
    again = GraphSession(spark)
    again.execute(f"IMPORT DATABASE '{path}'")
    return again.execute("MATCH (r:Region) RETURN r.r_regionkey AS k, r.r_name AS n")


add("export_import", _exported, "SELECT CAST(r_regionkey AS BIGINT) AS k, CASE WHEN r_name > 'B' THEN 'later' ELSE r_name END AS n FROM region")
add("save_open", _saved, "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' balances, streamed as JSON messages into Customer; the rows that the table has after it."""
    g, path = graph(spark, sf_dir), _scratch(spark, "in")
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal")).select(F.to_json(F.struct("c_custkey", "c_acctbal")).alias("value")).write.text(path)
    stream = readers.json_stream(spark.readStream.text(path), T.StructType.fromDDL("c_custkey long, c_acctbal double"))
    stream_into(g, "Customer", stream, _scratch(spark, "cp")).awaitTermination()
    return g.execute("MATCH (c:Customer) RETURN c.c_custkey AS k, c.c_name AS n, c.c_acctbal AS b")


add("stream_into", _streamed, "SELECT coalesce(c_custkey, o_custkey) AS k, c_name AS n, coalesce(p, c_acctbal) AS b FROM customer FULL JOIN (SELECT o_custkey, max(o_totalprice) AS p FROM orders GROUP BY 1) x ON o_custkey = c_custkey")
add("ddl_drop", after("CREATE NODE TABLE Gone (a INT64, PRIMARY KEY (a))", "DROP TABLE Gone", "CREATE NODE TABLE Gone (b STRING, PRIMARY KEY (b))", "CREATE (x:Gone {b: 'again'})", "MATCH (x:Gone) RETURN x.b AS b"), "SELECT 'again' AS b")
add("ddl_drop_column", after("ALTER TABLE Region ADD COLUMN more INT64 DEFAULT 4", "ALTER TABLE Region DROP COLUMN r_name", "ALTER TABLE Region COMMENT 'parts of the world'", "MATCH (r:Region) RETURN r"), "SELECT {'r_regionkey': CAST(r_regionkey AS BIGINT), 'more': CAST(4 AS BIGINT)} AS r FROM region")


def _arrow_bytes(df: DataFrame) -> bytes:
    import io

    import pyarrow as pa

    table, sink = df.toArrow(), io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue()


def _write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(data))
    out.close()


def _copied(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _scratch(spark, kind)
        g = graph(spark, sf_dir)
        if kind == "arrow":
            _write_bytes(spark, path, _arrow_bytes(g.catalog.need("Nation").df))
        else:
            g.execute(f"COPY Nation TO '{path}'")
        g.execute("CREATE NODE TABLE N2 (k INT64, name STRING, r INT64, extra STRING, PRIMARY KEY (k))")
        g.execute(f"COPY N2 FROM '{path}'")
        return g.execute("MATCH (n:N2) RETURN n.k AS k, n.name AS name, n.r AS r, n.extra AS x")

    return run


for _k in ("csv", "parquet", "arrow"):
    add(f"copy_{_k}", _copied(_k), "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, CAST(n_regionkey AS BIGINT) AS r, CAST(NULL AS VARCHAR) AS x FROM nation")


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    node = lambda k, c: F.concat(F.lit(f"http://x/{k}/"), F.col(c).cast("string"))
    row = lambda df, s, p, o, lit=None, dt=None: df.select(s.alias("s"), F.lit(p).alias("p"), (o if o is not None else F.lit(None).cast("string")).alias("o_uri"), (lit if lit is not None else F.lit(None).cast("string")).alias("o_lit"), F.lit(dt).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
    n, r = t("nation"), t("region")
    parts = [
        row(n, node("n", "n_nationkey"), rdf.TYPE, F.lit("http://x/Country")), row(r, node("r", "r_regionkey"), rdf.TYPE, F.lit("http://x/Continent")),
        row(n, node("n", "n_nationkey"), "http://x/name", None, F.col("n_name")), row(r, node("r", "r_regionkey"), "http://x/code", None, F.col("r_regionkey").cast("string"), rdf.XSD + "integer"),
        row(n, node("n", "n_nationkey"), "http://x#within", node("r", "n_regionkey")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])


def _nt_file(spark: SparkSession, sf_dir: str) -> str:
    """The triples as a folder of N-Triples files."""
    path, t = _scratch(spark, "nt"), _triples(spark, sf_dir)
    thing = F.when(F.col("o_uri").isNotNull(), F.concat(F.lit("<"), "o_uri", F.lit(">"))).otherwise(F.concat(F.lit('"'), "o_lit", F.lit('"'), F.coalesce(F.concat(F.lit("^^<"), "o_dt", F.lit(">")), F.lit(""))))
    t.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), thing, F.lit(" .")).alias("value")).write.text(path)
    return path


def _rdf_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GraphSession(spark)
    g.execute(f"LOAD FROM '{_nt_file(spark, sf_dir)}'")
    return g.execute("MATCH (c:Country)-[:within]->(k:Continent) RETURN c.name AS name, k.code AS code")


def _rdf_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GraphSession(spark)
    rdf.register_tables(g, rdf.infer(_triples(spark, sf_dir)))
    return g.execute("MATCH (c:Country)-[:within]->(k:Continent) RETURN c.name AS name, k.code AS code")


def _escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-Triples literals with escapes, beside a Turtle and an RDF/XML file of the same."""
    path = _scratch(spark, "nt")
    lines = [(r'<http://x/a> <http://x/p> "caf\u00e9 \U0001F600 a\\nb \"q\" \n\t."@fr .',), (r"<http://x/a> <http://x/q> <http://x/b> .",)]
    spark.createDataFrame(lines, "value string").write.text(path)
    return rdf.triples(spark, path).select("s", "p", "o_uri", F.hex(F.encode("o_lit", "UTF-8")).alias("o_lit"), "o_lang")


add("rdf_infer", _rdf_infer, "SELECT n_name AS name, CAST(n_regionkey AS BIGINT) AS code FROM nation JOIN region ON r_regionkey = n_regionkey")
add("rdf_load", _rdf_load, _sql["rdf_infer"])
add("rdf_escapes", _escapes, r"SELECT 'http://x/a' AS s, 'http://x/p' AS p, NULL AS o_uri, hex(encode('caf' || chr(233) || ' ' || chr(128512) || ' a\nb ' || chr(34) || 'q' || chr(34) || ' ' || chr(10) || chr(9) || '.')) AS o_lit, 'fr' AS o_lang UNION ALL SELECT 'http://x/a', 'http://x/q', 'http://x/b', NULL, NULL")
add("rdf_types", lambda s, d: GraphSession(s).execute(f"CALL rdf.types('{_nt_file(s, d)}')"), "SELECT 'http://x/Country' AS type_uri, 'Country' AS local_name, count(*) AS count FROM nation UNION ALL SELECT 'http://x/Continent', 'Continent', count(*) FROM region")
add("rdf_stats", lambda s, d: GraphSession(s).execute(f"CALL rdf.stats('{_nt_file(s, d)}')"), "WITH c AS (SELECT (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM region) AS r) SELECT 3 * n + 2 * r AS triple_count, n + r AS subject_count, CAST(4 AS BIGINT) AS predicate_count, n + r AS type_count FROM c")


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and vectors added through procedures, searched through procedures."""
    g = GraphSession(spark)
    g.texts.use(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("content")))
    return g.execute("CALL fts.search('stupid clown', 10) YIELD doc_id AS doc_id, score AS score RETURN doc_id, round(score * 1000000) / 1000000 AS score")


def _vector_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GraphSession(spark)
    g.call("vector.build", 3, "l2")
    for k, row in enumerate(("1,0,0", "0,1,0", "0,0,2", "1,1,1")):
        g.call("vector.add", k, row)
    return g.execute("CALL vector.search('1,0,0', 3) YIELD id AS id, distance AS distance")


add(
    "fts_must",
    lambda s, d: fts.bm25(s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("text").alias("content")), "+stupid -clown", 10).select("doc_id", F.round("score", 6).alias("score")),
    """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '' AND strlen(w) <= 40) AS w FROM documents),
f AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'clown')) AS a, len(list_filter(w, lambda x: x = 'stupid')) AS b FROM t),
s AS (SELECT count(*) AS n, avg(n) AS avg, count(*) FILTER (b > 0) AS db FROM f)
SELECT doc_id, round(ln(1 + (s.n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * f.n / avg)), 6) AS score
FROM f, s WHERE a = 0 AND b > 0 ORDER BY score DESC, doc_id LIMIT 10""",
)
add("fts_call", _searched, _sql["fts_bm25"])
add("vector_call", _vector_call, "SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(0 AS DOUBLE)), (1, 2), (3, 2)) v(id, distance)")

#: The heaviest shapes, for the benchmark.
HEADLINE = ("scan_filter_project", "pipeline_group", "sort_limit", "expr_arith", "agg_distinct", "join_3hop", "join_rel_props", "varlen_1_3", "algo_pagerank", "algo_wcc", "fts_bm25", "vector_l2", "delta_merge")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


