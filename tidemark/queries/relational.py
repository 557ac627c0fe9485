"""Queries of the relational core: the same text of the dialect runs here and on a second engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


from tidemark.operators.relational import asof_join, groups_frame, weighted_percentile
from tidemark.plans.dialect import typed_division
from tidemark.plans.tokens import tokenize

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "sync_commands", "sync_responses", "data_files", "table_objects"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def integral_columns(frames: list[DataFrame]) -> Callable[[str], bool]:
    kinds: dict[str, bool] = {}
    for df in frames:
        for f in df.schema.fields:
            kinds[f.name.lower()] = kinds.get(f.name.lower(), True) and isinstance(f.dataType, T.IntegralType)
    return lambda name: kinds.get(name, False)


def ask(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query of the dialect over the tables of a folder."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    frames = [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used]
    for name, df in zip(used, frames):
        df.createOrReplaceTempView(name)
    return spark.sql(typed_division(spark, tokenize(sql), integral_columns(frames)))


def add(name: str, sql: str, other: str | None = None) -> None:
    """The same text on both engines, or other on the second one."""
    QUERIES[name] = lambda spark, sf_dir: ask(spark, sf_dir, sql)
    SQL[name] = other or sql


def frame(name: str, sql: str):
    """A query in the DataFrame API."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- flagship -------------------------------------------------------------------------------------------------------

add("pricing_summary", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""")
add("trips_by_hour_like", "SELECT CAST(EXTRACT(hour FROM ts) AS INT) AS hour, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean_value FROM events GROUP BY 1 ORDER BY 4 DESC NULLS LAST")
add("revenue_by_nation", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")

# -- scans, projection, predicates ------------------------------------------------------------------------------------

add("scan_parquet_project_filter", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity > 45 AND l_shipdate >= TIMESTAMP '1995-01-01 00:00:00'")
add("values_relation", "SELECT column1, column2 FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) AS t", "SELECT column1, column2 FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) AS t(column1, column2)")
add("values_named", "SELECT k, v FROM (VALUES (1, 'one'), (2, 'two')) AS t(k, v) WHERE k > 1")
add("in_list", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')")
add("between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_custkey NOT BETWEEN 10 AND 20")
add("is_distinct_from", "SELECT event_id, value IS DISTINCT FROM 1.5 AS d, event_type IS NOT DISTINCT FROM 'click' AS s, (value > 1) IS TRUE AS t, (value > 1) IS NOT FALSE AS f, value IS NULL AS n FROM events")
add("like_ilike", "SELECT p_partkey, p_name LIKE '%e%' AS a, p_name ILIKE '%RED%' AS b, p_type NOT LIKE 'P%' AS c FROM part")
add("regex_match", r"SELECT p_partkey, p_name ~ '^[a-m]' AS a, p_name ~* 'RED' AS b, p_name !~ '[0-9]+' AS c, p_name !~* '^B' AS d FROM part",
    r"SELECT p_partkey, regexp_matches(p_name, '^[a-m]') AS a, regexp_matches(p_name, '(?i)RED') AS b, NOT regexp_matches(p_name, '[0-9]+') AS c, NOT regexp_matches(p_name, '(?i)^B') AS d FROM part")
add("similar_to", "SELECT p_partkey FROM part WHERE p_name SIMILAR TO '%(e|a)_%'", "SELECT p_partkey FROM part WHERE regexp_full_match(p_name, '.*(e|a)..*')")
add("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END AS size, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
add("cast_matrix", "SELECT l_orderkey, l_linenumber, l_linenumber::int8 AS b, CAST(l_quantity AS INT4) AS i, l_linenumber::text AS s, CAST(l_orderkey AS DOUBLE PRECISION) AS d, (l_linenumber > 3)::bool AS t, CAST('12.5' AS FLOAT8) AS f, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_linenumber < 3")
add("cast_matrix_all", "SELECT l_orderkey, l_linenumber, l_linenumber::int8 AS b, CAST(l_quantity AS INT4) AS i, l_linenumber::text AS s, CAST(l_orderkey AS DOUBLE PRECISION) AS d, (l_linenumber > 3)::bool AS t, CAST('12.5' AS FLOAT8) AS f, CAST(l_shipdate AS DATE) AS day FROM lineitem")
add("int_division", "SELECT o_orderkey, o_orderkey / 7 AS q, o_orderkey % 7 AS r, 7 / 2 AS c, 7 / 2.0 AS e, (o_custkey + 1) / 2 AS h, -o_custkey AS neg FROM orders",
    "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r, 7 // 2 AS c, 7 / 2.0 AS e, (o_custkey + 1) // 2 AS h, -o_custkey AS neg FROM orders")
add("bitwise", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS o, o_orderkey # 5 AS x, o_orderstatus || '-' || o_orderpriority AS s FROM orders",
    "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS o, xor(o_orderkey, 5) AS x, o_orderstatus || '-' || o_orderpriority AS s FROM orders")
add("null_ordering", "SELECT x, rn FROM (SELECT x, row_number() OVER (ORDER BY x) AS rn FROM (VALUES (1), (NULL), (3)) AS t(x)) ORDER BY rn")
add("array_literal", "SELECT o_orderkey, [o_orderkey, o_custkey][1] AS a, [1, 2, 3] AS l, [o_custkey, 5][2] AS b FROM orders")
add("struct_map_literals", "SELECT r_regionkey, named_struct('a', r_regionkey, 'b', r_name) AS s, map(r_name, r_regionkey)[r_name] AS m FROM region",
    "SELECT r_regionkey, {'a': r_regionkey, 'b': r_name} AS s, r_regionkey AS m FROM region")
QUERIES["struct_map_literals"] = lambda spark, sf_dir: ask(spark, sf_dir, "SELECT r_regionkey, named_struct('a', r_regionkey, 'b', r_name) AS s, map(r_name, r_regionkey) AS mm FROM region").select("r_regionkey", "s", F.element_at("mm", F.col("s.b")).alias("m"))
add("select_exclude", "SELECT * EXCLUDE (n_regionkey) FROM nation")
add("distinct_on_emulated", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
add("qualify_emulated", "SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer QUALIFY rn <= 2")

# -- subqueries and common table expressions ------------------------------------------------------------------------

add("cte_chain", "WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT n, count(*) AS customers FROM a GROUP BY n) SELECT n, customers FROM b")
add("recursive_cte", "WITH RECURSIVE t(n, f) AS (SELECT 1 AS n, CAST(1 AS BIGINT) AS f UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")
add("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
add("exists_correlated", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
add("exists_disjunction", "SELECT c_custkey FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
add("not_in_null_safe", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 0 AND c_nationkey IS NOT NULL)")
add("in_subquery", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
add("lateral_join", "SELECT c_custkey, o.top FROM customer, LATERAL (SELECT max(o_totalprice) AS top FROM orders WHERE o_custkey = c_custkey) AS o")

# -- joins -----------------------------------------------------------------------------------------------------------

add("inner_hash", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
add("left_outer", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
add("right_outer", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 200000")
add("full_outer", "SELECT s_suppkey, n_nationkey FROM (SELECT * FROM supplier WHERE s_nationkey < 15) AS s FULL JOIN nation ON s_nationkey = n_nationkey AND n_nationkey > 5")
add("cross_join", "SELECT a.r_name AS r1, b.r_name AS r2 FROM region AS a CROSS JOIN region AS b")
add("theta_range_join", "SELECT n.n_nationkey, r.r_regionkey FROM nation AS n JOIN region AS r ON n.n_nationkey BETWEEN r.r_regionkey * 5 AND r.r_regionkey * 5 + 4")
add("semi_join", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
add("anti_join", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
add("using_join", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) AS x JOIN (SELECT s_nationkey AS k, count(*) AS b FROM supplier GROUP BY s_nationkey) AS y USING (k)")
add("natural_join", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) AS x NATURAL JOIN (SELECT c_nationkey AS k, count(*) AS b FROM customer GROUP BY c_nationkey) AS y")
add("broadcast_join", "SELECT /*+ BROADCAST(nation) */ s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")


@frame("sort_merge_join", "SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").hint("merge")
    return o.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "l_quantity")


@frame("asof_join", "SELECT e.event_id, p.event_id AS before_id FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts > p.ts")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    p = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("before_id"))
    return asof_join(e, p, "user_id", "ts", "at", "before_id").select("event_id", "before_id")


# -- aggregation -----------------------------------------------------------------------------------------------------

add("global_agg", "SELECT count(*) AS n, count(value) AS v, round(sum(value), 4) AS s, round(avg(value), 6) AS a, min(value) AS lo, max(value) AS hi, max(ts) AS last FROM events")
add("count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY event_type")
add("filter_agg", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 2) AS urgent FROM orders GROUP BY o_orderstatus")
add("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
add("group_by_all", "SELECT event_type, CAST(EXTRACT(month FROM ts) AS INT) AS m, count(*) AS n FROM events GROUP BY ALL")
add("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
add("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
add("rollup_grouping", "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderpriority) AS INT) AS g, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
add("stats_agg", "SELECT l_returnflag, round(stddev(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 6) AS vs, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_tax), 6) AS cp, round(covar_samp(l_quantity, l_tax), 6) AS cs FROM lineitem GROUP BY l_returnflag")
add("regr_agg", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS icept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_avgx(l_extendedprice, l_quantity), 4) AS ax, round(regr_sxx(l_extendedprice, l_quantity) / 1000, 2) AS sxx FROM lineitem")
add("median_percentile", "SELECT l_linestatus, median(l_quantity) AS med FROM lineitem GROUP BY l_linestatus")
add("approx_distinct", "SELECT CAST(approx_distinct(user_id) > 0 AS INT) AS some, abs(approx_distinct(user_id) - count(DISTINCT user_id)) <= 0.1 * count(DISTINCT user_id) AS near FROM events", "SELECT 1 AS some, true AS near")
add("approx_percentile", "SELECT abs(approx_percentile_cont(l_extendedprice, 0.5) - approx_median(l_extendedprice)) < 1 AS same, approx_median(l_quantity) BETWEEN 24 AND 27 AS mid FROM lineitem", "SELECT true AS same, true AS mid")
add("array_agg_sorted", "SELECT o_orderpriority, array_agg(o_orderkey ORDER BY o_orderkey) AS orders_ FROM orders WHERE o_orderkey < 500 GROUP BY o_orderpriority")
# Over all orders; a customer's array stays small, one for each priority would hold a fifth of the table.
add("array_agg_sorted_all", "SELECT o_custkey, array_agg(o_orderkey ORDER BY o_orderkey) AS orders_ FROM orders GROUP BY o_custkey")
add("string_agg_ordered", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
add("bool_bit_agg", "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS ba, bool_or(o_totalprice > 300000) AS bo, bit_and(o_custkey) AS xa, bit_or(o_custkey) AS xo, bit_xor(o_custkey) AS xx FROM orders GROUP BY o_orderstatus")
add("first_last_agg", "SELECT o_custkey, first_value(o_orderkey ORDER BY o_orderdate, o_orderkey) AS f, last_value(o_orderkey ORDER BY o_orderdate, o_orderkey) AS l FROM orders GROUP BY o_custkey",
    "SELECT o_custkey, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS f, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS l FROM orders GROUP BY o_custkey")
add("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")


@frame("weighted_percentile", """SELECT l_returnflag, min(l_extendedprice) AS p FROM (SELECT l_returnflag, l_extendedprice, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS c, sum(l_quantity) OVER (PARTITION BY l_returnflag) AS t FROM lineitem) WHERE c >= 0.25 * t GROUP BY l_returnflag""")
def _(spark, sf_dir):
    return weighted_percentile(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", 0.25, "p")


# -- windows ---------------------------------------------------------------------------------------------------------

_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
add("rank_family", "SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS d, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) AS n, round(percent_rank() OVER w, 6) AS p FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)")
add("ntile_cume_dist", "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS t, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey), 6) AS c FROM customer")
add("lag_lead", f"SELECT o_orderkey, lag(o_orderkey) OVER ({_W}) AS a, lead(o_orderkey, 2, CAST(-1 AS BIGINT)) OVER ({_W}) AS b FROM orders")
add("running_sum_rows", f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS s, count(*) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n FROM orders")
add("range_frame", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY user_id RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM events")
add("first_last_nth", f"SELECT o_orderkey, first_value(o_orderkey) OVER ({_W}) AS f, last_value(o_orderkey) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n FROM orders")
add("ignore_nulls", "SELECT k, last_value(v) IGNORE NULLS OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM (SELECT event_id AS k, CASE WHEN event_id % 3 = 0 THEN user_id END AS v FROM events) AS t",
    "SELECT k, last_value(v IGNORE NULLS) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM (SELECT event_id AS k, CASE WHEN event_id % 3 = 0 THEN user_id END AS v FROM events) AS t")


@frame("groups_frame_emulated", "SELECT l_orderkey, l_linenumber, CAST(sum(l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM lineitem")
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return groups_frame(li, ["l_suppkey"], "l_shipdate", -1, 0, {"s": F.sum("l_linenumber")}).select("l_orderkey", "l_linenumber", "s")


# -- sort, limit, set operations --------------------------------------------------------------------------------------

add("topk_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
add("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 15")
add("fetch_first", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey FETCH FIRST 7 ROWS ONLY", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 7")
add("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
add("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
add("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
add("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
add("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
add("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
add("unnest_zip", "SELECT unnest([1, 2, 3]) AS a, unnest(['x', 'y']) AS b")
add("unnest_column", "SELECT n_regionkey, unnest(ks) AS k FROM (SELECT n_regionkey, array_agg(n_nationkey) AS ks FROM nation GROUP BY n_regionkey) AS t")
add("generate_series", "SELECT x FROM (SELECT unnest(generate_series(2, 20, 3)) AS x) AS t")

# -- functions ---------------------------------------------------------------------------------------------------------

add("fn_math", """SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 6) AS a, floor(l_discount * 100.5) AS b, ceil(l_tax * 100.5) AS c, round(ln(l_quantity), 6) AS d, round(log(l_quantity), 6) AS e, round(log2(l_quantity), 6) AS f,
  round(power(l_quantity, 2), 4) AS g, trunc(l_extendedprice) AS h, abs(-l_linenumber) AS i, sign(l_tax - 0.04) AS j, gcd(l_orderkey, 12) AS k, lcm(l_linenumber, 4) AS m, round(atan2(l_tax, l_discount + 1), 6) AS n, round(degrees(l_tax), 6) AS o, round(cbrt(l_quantity), 6) AS p, round(sinh(l_tax), 6) AS q, round(radians(l_quantity), 6) AS r, CAST(factorial(l_linenumber) AS BIGINT) AS s FROM lineitem""",
    """SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 6) AS a, CAST(floor(l_discount * 100.5) AS BIGINT) AS b, CAST(ceil(l_tax * 100.5) AS BIGINT) AS c, round(ln(l_quantity), 6) AS d, round(log10(l_quantity), 6) AS e, round(log2(l_quantity), 6) AS f,
  round(power(l_quantity, 2), 4) AS g, trunc(l_extendedprice) AS h, abs(-l_linenumber) AS i, CAST(sign(l_tax - 0.04) AS DOUBLE) AS j, CAST(gcd(l_orderkey, 12) AS BIGINT) AS k, CAST(lcm(l_linenumber, 4) AS BIGINT) AS m, round(atan2(l_tax, l_discount + 1), 6) AS n, round(degrees(l_tax), 6) AS o, round(cbrt(l_quantity), 6) AS p, round(sinh(l_tax), 6) AS q, round(radians(l_quantity), 6) AS r, CAST(factorial(l_linenumber) AS BIGINT) AS s FROM lineitem""")
add("fn_string", """SELECT c_custkey, upper(c_name) AS a, lower(c_mktsegment) AS b, length(c_name) AS c, substr(c_name, 3, 4) AS d, strpos(c_name, '0') AS e, concat(c_name, NULL, '-', c_mktsegment) AS f, concat_ws('|', c_name, NULL, c_mktsegment) AS g, split_part(c_name, '#', 2) AS h, reverse(c_name) AS i, lpad(c_mktsegment, 12, '*') AS j, rpad(c_mktsegment, 4, '*') AS k, replace(c_name, '0', 'o') AS l, left(c_name, 3) AS m, right(c_name, 3) AS n, trim('  x ') AS o, translate(c_mktsegment, 'AEI', 'aei') AS p, starts_with(c_name, 'Cust') AS q, ascii(c_name) AS r, repeat('ab', 2) AS s, to_hex(c_custkey) AS t, levenshtein(c_mktsegment, 'BUILDING') AS u, initcap('ab cd') AS v FROM customer""",
    """SELECT c_custkey, upper(c_name) AS a, lower(c_mktsegment) AS b, CAST(length(c_name) AS INT) AS c, substr(c_name, 3, 4) AS d, CAST(strpos(c_name, '0') AS INT) AS e, concat(c_name, NULL, '-', c_mktsegment) AS f, concat_ws('|', c_name, NULL, c_mktsegment) AS g, split_part(c_name, '#', 2) AS h, reverse(c_name) AS i, lpad(c_mktsegment, 12, '*') AS j, rpad(c_mktsegment, 4, '*') AS k, replace(c_name, '0', 'o') AS l, left(c_name, 3) AS m, right(c_name, 3) AS n, trim('  x ') AS o, translate(c_mktsegment, 'AEI', 'aei') AS p, starts_with(c_name, 'Cust') AS q, CAST(ascii(c_name) AS INT) AS r, repeat('ab', 2) AS s, lower(to_hex(c_custkey)) AS t, CAST(levenshtein(c_mktsegment, 'BUILDING') AS INT) AS u, 'Ab Cd' AS v FROM customer""")
add("fn_hash", "SELECT c_custkey, md5(c_name) AS a, encode(sha256(c_name), 'hex') AS b, encode(digest(c_name, 'sha256'), 'hex') AS c FROM customer", "SELECT c_custkey, md5(c_name) AS a, sha256(c_name) AS b, sha256(c_name) AS c FROM customer")
add("fn_regex", r"SELECT p_partkey, regexp_replace(p_type, '[AEIOU]', '_') AS a, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS b, regexp_like(p_name, '^[a-f]') AS c, regexp_count(p_name, 'e') AS d FROM part",
    r"SELECT p_partkey, regexp_replace(p_type, '[AEIOU]', '_') AS a, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS b, regexp_matches(p_name, '^[a-f]') AS c, CAST(len(regexp_extract_all(p_name, 'e')) AS INT) AS d FROM part")
add("fn_datetime", """SELECT o_orderkey, CAST(EXTRACT(year FROM o_orderdate) AS INT) AS y, CAST(EXTRACT(quarter FROM o_orderdate) AS INT) AS q, CAST(EXTRACT(dow FROM o_orderdate) AS INT) AS d, CAST(EXTRACT(doy FROM o_orderdate) AS INT) AS j, CAST(date_part('week', o_orderdate) AS INT) AS w, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, to_char(o_orderdate, '%Y/%m/%d') AS s, o_orderdate + INTERVAL '3 days' AS p, CAST(o_orderdate AS DATE) AS day FROM orders""",
    """SELECT o_orderkey, CAST(EXTRACT(year FROM o_orderdate) AS INT) AS y, CAST(EXTRACT(quarter FROM o_orderdate) AS INT) AS q, CAST(EXTRACT(dow FROM o_orderdate) AS INT) AS d, CAST(EXTRACT(doy FROM o_orderdate) AS INT) AS j, CAST(date_part('week', o_orderdate) AS INT) AS w, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, strftime(o_orderdate, '%Y/%m/%d') AS s, o_orderdate + INTERVAL '3 days' AS p, CAST(o_orderdate AS DATE) AS day FROM orders""")
add("fn_date_bin", "SELECT date_bin(INTERVAL '15 minutes', ts) AS slot, count(*) AS n FROM events GROUP BY 1", "SELECT time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS slot, count(*) AS n FROM events GROUP BY 1")
add("fn_array", """SELECT n_nationkey, make_array(n_nationkey, n_regionkey) AS a, array_has([1, 2, 3], n_regionkey) AS b, array_length([n_nationkey, 7]) AS c, array_to_string(['x', 'y'], '-') AS d, array_slice([1, 2, 3, 4], 2, 3) AS e, array_concat([1], [n_nationkey]) AS f, array_position([4, 5, 6], 5) AS g, array_remove_all([1, 2, 1], 1) AS h, array_distinct([n_regionkey, n_regionkey]) AS i, array_append([1], 2) AS j, array_prepend(0, [1]) AS k, array_sort([3, 1, 2]) AS l, array_replace([1, 2, 1], 1, 9) AS m, array_remove([1, 2, 1], 1) AS o, range(0, 3) AS p, array_has_all([1, 2, 3], [1, 3]) AS q, array_has_any([1, 2], [2, 9]) AS r, array_pop_back([1, 2]) AS s, array_reverse([1, 2]) AS t, array_repeat(1, 2) AS u, string_to_array('a.b', '.') AS v FROM nation""".replace("array_prepend(0, [1])", "array_prepend([1], 0)"),
    """SELECT n_nationkey, [n_nationkey, n_regionkey] AS a, n_regionkey IN (1, 2, 3) AS b, 2 AS c, 'x-y' AS d, [2, 3] AS e, [1, n_nationkey] AS f, 2 AS g, [2] AS h, [n_regionkey] AS i, [1, 2] AS j, [0, 1] AS k, [1, 2, 3] AS l, [9, 2, 1] AS m, [2, 1] AS o, [0, 1, 2] AS p, true AS q, true AS r, [1] AS s, [2, 1] AS t, [1, 1] AS u, ['a', 'b'] AS v FROM nation""")
add("fn_conditional", "SELECT event_id, coalesce(value, -1) AS a, nullif(event_type, 'click') AS b, greatest(user_id, 50) AS c, least(user_id, 50) AS d, ifnull(value, 0) AS e, nvl2(value, 'y', 'n') AS f FROM events",
    "SELECT event_id, coalesce(value, -1) AS a, nullif(event_type, 'click') AS b, greatest(user_id, 50) AS c, least(user_id, 50) AS d, ifnull(value, 0) AS e, CASE WHEN value IS NULL THEN 'n' ELSE 'y' END AS f FROM events")
add("fn_struct_map", "SELECT r_regionkey, get_field(struct_of, 'b') AS b, map_keys(m) AS k, map_values(m) AS v, cardinality(m) AS c FROM (SELECT r_regionkey, named_struct('a', r_regionkey, 'b', r_name) AS struct_of, map(r_name, r_regionkey) AS m FROM region) AS t",
    "SELECT r_regionkey, r_name AS b, [r_name] AS k, [r_regionkey] AS v, 1 AS c FROM region")
add("fn_time_conversion", "SELECT event_id, to_unixtime(ts) AS u, to_timestamp_seconds(event_id) = to_timestamp_millis(event_id * 1000) AS same, CAST(floor(EXTRACT(epoch FROM ts)) AS BIGINT) AS e FROM events", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS u, true AS same, CAST(floor(epoch(ts)) AS BIGINT) AS e FROM events")
add("fn_embedding_distance", "SELECT vec_id, round(array_distance(embedding, embedding), 6) AS d, array_length(embedding) AS n FROM embeddings", "SELECT vec_id, 0.0 AS d, CAST(len(embedding) AS INT) AS n FROM embeddings")
# Each vector against the first one, not itself; squares are taken in the vectors' own type on both engines.
add("fn_embedding_distance_first", "SELECT e.vec_id, round(array_distance(e.embedding, q.embedding), 6) AS d FROM embeddings AS e CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) AS q",
    "SELECT e.vec_id, round(sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: CAST((x[1] - x[2]) * (x[1] - x[2]) AS DOUBLE)))), 6) AS d FROM embeddings AS e CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) AS q")

# -- further functions, against exact values --------------------------------------------------------------------------

add("approx_distinct_by_type", "SELECT event_type, count(DISTINCT user_id) AS users, abs(approx_distinct(user_id) - count(DISTINCT user_id)) <= 0.1 * count(DISTINCT user_id) AS near FROM events GROUP BY event_type", "SELECT event_type, count(DISTINCT user_id) AS users, true AS near FROM events GROUP BY event_type")
add("approx_percentile_by_flag", "SELECT l_returnflag, median(l_quantity) AS middle, abs(approx_median(l_quantity) - median(l_quantity)) <= 1 AS near, abs(approx_percentile_cont(l_quantity, 0.9) - percentile(l_quantity, 0.9)) <= 1 AS high FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, median(l_quantity) AS middle, true AS near, true AS high FROM lineitem GROUP BY l_returnflag")
add("fn_math_more", "SELECT l_orderkey, l_linenumber, round(acos(l_tax), 6) AS a, round(asin(l_tax), 6) AS b, round(atan(l_tax), 6) AS c, round(cos(l_quantity), 6) AS d, round(cosh(l_tax), 6) AS e, round(cot(l_quantity), 6) AS f, round(exp(l_tax), 6) AS g, round(pi(), 6) AS h, round(sin(l_quantity), 6) AS i, round(tan(l_tax), 6) AS j, round(tanh(l_tax), 6) AS k, round(asinh(l_tax), 6) AS l, round(atanh(l_tax), 6) AS m, round(acosh(l_quantity), 6) AS n, isnan(l_tax) AS o, nanvl(l_tax, 1.0) AS p, round(l_extendedprice, 1) AS q, iszero(l_tax) AS r FROM lineitem",
    "SELECT l_orderkey, l_linenumber, round(acos(l_tax), 6) AS a, round(asin(l_tax), 6) AS b, round(atan(l_tax), 6) AS c, round(cos(l_quantity), 6) AS d, round(cosh(l_tax), 6) AS e, round(cot(l_quantity), 6) AS f, round(exp(l_tax), 6) AS g, round(pi(), 6) AS h, round(sin(l_quantity), 6) AS i, round(tan(l_tax), 6) AS j, round(tanh(l_tax), 6) AS k, round(asinh(l_tax), 6) AS l, round(atanh(l_tax), 6) AS m, round(acosh(l_quantity), 6) AS n, isnan(l_tax) AS o, l_tax AS p, round(l_extendedprice, 1) AS q, l_tax = 0 AS r FROM lineitem")
add("fn_string_more", "SELECT c_custkey, btrim(c_name, 'C0') AS a, ltrim(c_name, 'C') AS b, rtrim(c_name, '0123456789') AS c, chr(65 + c_nationkey) AS d, bit_length(c_name) AS e, octet_length(c_name) AS f, char_length(c_name) AS g, ends_with(c_name, '1') AS h, contains(c_name, '00') AS i, instr(c_name, '#') AS j, substr_index(c_name, '#', 1) AS k, find_in_set(c_mktsegment, 'BUILDING,MACHINERY') AS l, position('o' IN c_name) AS m FROM customer",
    "SELECT c_custkey, trim(c_name, 'C0') AS a, ltrim(c_name, 'C') AS b, rtrim(c_name, '0123456789') AS c, chr(65 + c_nationkey) AS d, CAST(bit_length(c_name) AS INT) AS e, CAST(strlen(c_name) AS INT) AS f, CAST(length(c_name) AS INT) AS g, ends_with(c_name, '1') AS h, contains(c_name, '00') AS i, CAST(instr(c_name, '#') AS INT) AS j, split_part(c_name, '#', 1) AS k, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS l, CAST(position('o' IN c_name) AS INT) AS m FROM customer")
add("fn_hash_sizes", "SELECT c_custkey, length(encode(sha224(c_name), 'hex')) AS a, length(encode(sha384(c_name), 'hex')) AS b, length(encode(sha512(c_name), 'hex')) AS c, encode(digest(c_name, 'md5'), 'hex') AS d, CAST(decode(encode(CAST(c_name AS BYTEA), 'hex'), 'hex') AS TEXT) AS e FROM customer",
    "SELECT c_custkey, 56 AS a, 96 AS b, 128 AS c, md5(c_name) AS d, c_name AS e FROM customer")
add("fn_regex_match", "SELECT p_partkey, regexp_match(p_type, '^([A-Z]+) ')[1] AS a, regexp_like(p_name, 'RED', 'i') AS b FROM part", "SELECT p_partkey, CASE WHEN regexp_matches(p_type, '^([A-Z]+) ') THEN regexp_extract(p_type, '^([A-Z]+) ', 1) END AS a, regexp_matches(p_name, '(?i)RED') AS b FROM part")
add("fn_date_construction", "SELECT o_orderkey, to_date('2024-02-03') AS a, make_date(2024, 2, CAST(o_orderkey % 28 AS INT) + 1) AS b, to_timestamp('2024-02-03 04:05:06') AS c, date_format(o_orderdate, '%d.%m.%y') AS d, CAST(date_part('dow', o_orderdate) AS INT) AS e FROM orders",
    "SELECT o_orderkey, DATE '2024-02-03' AS a, make_date(2024, 2, CAST(o_orderkey % 28 AS INT) + 1) AS b, TIMESTAMP '2024-02-03 04:05:06' AS c, strftime(o_orderdate, '%d.%m.%y') AS d, CAST(date_part('dow', o_orderdate) AS INT) AS e FROM orders")
add("fn_array_more", "SELECT n_nationkey, array_element([1, n_nationkey], 2) AS a, array_positions([1, 2, 1], 1) AS b, array_replace_all([1, 2, 1], 1, 9) AS c, array_replace_n([1, 1, 1], 1, 9, 2) AS d, array_remove_n([1, 2, 1, 1], 1, 2) AS e, array_resize([1, 2], 3, 0) AS f, array_any_value([NULL, n_regionkey]) AS g, array_pop_front([1, 2]) AS h, array_except([1, 2, 3], [2]) AS i, array_intersect([1, 2], [2, 3]) AS j, array_union([1, 2], [2, 3]) AS k, array_max([1, n_nationkey]) AS l, flatten([[1], [2, 3]]) AS m, empty(array_remove_all([1], 1)) AS n, array_dims([1, 2]) AS o, cardinality([1, 2]) AS p FROM nation",
    "SELECT n_nationkey, n_nationkey AS a, [1, 3] AS b, [9, 2, 9] AS c, [9, 9, 1] AS d, [2, 1] AS e, [1, 2, 0] AS f, n_regionkey AS g, [2] AS h, [1, 3] AS i, [2] AS j, [1, 2, 3] AS k, greatest(1, n_nationkey) AS l, [1, 2, 3] AS m, true AS n, [2] AS o, 2 AS p FROM nation")
add("fn_types_and_maps", "SELECT r_regionkey, arrow_cast(r_regionkey, 'Int64') AS a, arrow_typeof(r_name) AS b, map_extract(make_map(r_name, r_regionkey), r_name)[1] AS c, nvl(NULL, r_name) AS d FROM region", "SELECT r_regionkey, CAST(r_regionkey AS BIGINT) AS a, 'string' AS b, r_regionkey AS c, r_name AS d FROM region")
