"""The relational surface: one registered query for each operator of the exact engine.

Where Spark has the operator, the query is SQL that both engines run; where it
lacks it, the query uses a rewrite of :mod:`driftgauge.functions.compat` and the
oracle the operator itself.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgauge import tables
from driftgauge.functions import compat, stats

#: Queries whose text both engines run.
SHARED: dict[str, str] = {
    # scans, projection, predicates
    "scan_filter": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= date '1997-01-01' AND l_shipdate < date '1997-02-01' AND l_discount > 0.05",
    "values_scan": "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(id, name)",
    "cte_scan": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT count(*) AS n, round(max(total), 2) AS most FROM big WHERE total > 100000",
    "subquery_scan": "SELECT segment, n FROM (SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY c_mktsegment) t WHERE n > 10",
    "projection_expr": "SELECT p_partkey, round(p_retailprice * 1.1 + p_size, 2) AS price, p_size % 7 AS r FROM part",
    "boolean_tests": "SELECT c_custkey, (c_acctbal > 0) IS TRUE AS pos, (c_acctbal > 9000 OR c_nationkey = 3) IS NOT TRUE AS rest, NOT (c_nationkey = 1) AS other FROM customer",
    "is_distinct_from": "SELECT count(*) AS n FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey WHERE nullif(a.c_nationkey, 3) IS DISTINCT FROM b.c_nationkey",
    "between_in": "SELECT count(*) AS n FROM part WHERE p_size BETWEEN 10 AND 20 AND p_type IN ('PROMO', 'SMALL') AND p_brand NOT IN ('Brand#1', 'Brand#2')",
    "like_patterns": "SELECT p_partkey FROM part WHERE p_name LIKE 'blue%' AND p_name NOT LIKE '%gear' AND lower(p_type) LIKE '_romo'",
    "any_all": "SELECT count(*) AS n FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name < 'B') AND n_nationkey >= (SELECT max(n_nationkey) FROM nation WHERE n_nationkey < 2)",
    "case_coalesce": "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus, 'P'), '?') AS status, greatest(o_custkey, 700) AS g, least(o_custkey, 700) AS l FROM orders",
    "row_comparison": "SELECT count(*) AS n FROM lineitem WHERE l_orderkey < 500 OR (l_orderkey = 500 AND l_linenumber < 3)",
    "generated_column": "SELECT o_orderkey, o_totalprice * 0.19 AS tax FROM orders WHERE o_totalprice * 0.19 > 80000",
    # joins
    "join_inner": "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "join_left_extra": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '5-LOW' GROUP BY c_custkey",
    "join_full": "SELECT count(*) AS n, count(a.c_custkey) AS l, count(b.s_suppkey) AS r FROM customer a FULL JOIN supplier b ON a.c_custkey = b.s_suppkey + 1450",
    "join_semi": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY o_orderpriority",
    "join_anti": "SELECT count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "join_not_in": "SELECT count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)",
    "join_theta": "SELECT count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_non_equi_term": "SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey",
    "join_composite": "SELECT count(*) AS n FROM lineitem a JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 49) b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey",
    "join_or": "SELECT count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey AND (n_name = 'NATION_1' OR (n_name = 'NATION_2' AND s_acctbal > 0))",
    "join_using": "SELECT count(*) AS n FROM (SELECT n_nationkey AS k FROM nation) a JOIN (SELECT s_nationkey AS k FROM supplier) b USING (k)",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE n_nationkey < 3",
    "join_null_safe": "SELECT count(*) AS n FROM (SELECT nullif(n_regionkey, 2) AS k FROM nation) a JOIN (SELECT nullif(r_regionkey, 2) AS k FROM region) b ON a.k IS NOT DISTINCT FROM b.k",
    "join_lateral": "SELECT r_name, m.most FROM region, LATERAL (SELECT max(n_nationkey) AS most FROM nation WHERE n_regionkey = r_regionkey) m",
    "join_range": "SELECT b.lo, count(*) AS n FROM part JOIN (VALUES (1, 11), (11, 26), (26, 51)) AS b(lo, hi) ON p_size >= b.lo AND p_size < b.hi GROUP BY b.lo",
    "join_self": "SELECT count(*) AS n FROM nation n1, nation n2, region WHERE n1.n_regionkey = r_regionkey AND n2.n_regionkey = r_regionkey AND r_name = 'ASIA'",
    "scalar_subquery": "SELECT count(*) AS n FROM lineitem l WHERE l_quantity < (SELECT 0.2 * avg(l_quantity) FROM lineitem m WHERE m.l_partkey = l.l_partkey)",
    "scalar_uncorrelated": "SELECT s_suppkey FROM supplier WHERE s_acctbal = (SELECT max(s_acctbal) FROM supplier)",
    # aggregation
    "agg_plain": "SELECT count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS d, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem",
    "agg_grouped": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "group_only": "SELECT c_mktsegment, c_nationkey FROM customer GROUP BY c_mktsegment, c_nationkey",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n, cast(grouping(l_returnflag) AS int) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "rollup": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)",
    "cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "having": "SELECT l_suppkey, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) > (SELECT 1.05 * avg(q) FROM (SELECT sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey) t)",
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag",
    "agg_filter": "SELECT count(*) FILTER (WHERE o_totalprice > 200000) AS high, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders",
    "percentiles": "SELECT c_mktsegment, percentile_disc(0.5) WITHIN GROUP (ORDER BY c_acctbal) AS pd, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY c_acctbal), 4) AS pc FROM customer GROUP BY c_mktsegment",
    "variance_family": "SELECT round(stddev_samp(l_quantity), 6) AS s, round(var_pop(l_quantity), 6) AS v, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS cv, round(regr_slope(l_extendedprice, l_quantity), 4) AS r FROM lineitem",
    "bool_aggs": "SELECT n_regionkey, bool_and(n_nationkey > 3) AS a, bool_or(n_nationkey > 20) AS o FROM nation GROUP BY n_regionkey",
    "agg_expressions": "SELECT l_linenumber, round(sum(l_extendedprice * (1 - l_discount)) / count(*), 4) AS m FROM lineitem GROUP BY l_linenumber",
    "functional_dependency": "SELECT s_suppkey, any_value(s_name) AS name, count(*) AS n FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey",
    "select_distinct": "SELECT DISTINCT p_brand, p_type FROM part",
    "left_outer_histogram": "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) t GROUP BY c_count",
    # windows
    "window_ranks": "SELECT c_custkey, cast(row_number() OVER w AS bigint) AS rn, cast(rank() OVER w AS bigint) AS rk, cast(dense_rank() OVER w AS bigint) AS dr FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)",
    "window_distribution": "SELECT s_suppkey, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, cast(ntile(4) OVER w AS bigint) AS nt FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)",
    "window_lag_lead": "SELECT o_orderkey, lag(o_totalprice) OVER w AS prev, lead(o_totalprice, 2, 0.0) OVER w AS nxt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "window_values": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "window_running": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS run, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mx FROM orders",
    "window_range_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM part",
    "window_over_agg": "SELECT l_returnflag, count(*) AS n, cast(sum(count(*)) OVER () AS bigint) AS total FROM lineitem GROUP BY l_returnflag",
    # sort, limit, sets
    "top_n": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "limit_offset": "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5 OFFSET 20",
    "nulls_order": "SELECT k FROM (SELECT nullif(n_regionkey, 1) AS k, n_nationkey AS i FROM nation) t ORDER BY k DESC NULLS LAST, i LIMIT 22",
    "merge_append": "SELECT k, s FROM (SELECT c_custkey AS k, 'c' AS s FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier) t ORDER BY k, s LIMIT 60",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect_ops": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except_ops": "SELECT l_partkey AS k FROM lineitem WHERE l_quantity < 3 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "recursive_union": "WITH RECURSIVE t(n, f) AS (SELECT 1, cast(1 AS bigint) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t",
    "arm_types": "SELECT cast(1 AS bigint) AS x UNION ALL SELECT n_nationkey FROM nation WHERE n_nationkey < 2",
    # scalar functions
    "fn_string": "SELECT p_partkey, upper(p_name) AS u, substring(p_name, 2, 4) AS s, trim(concat('  ', p_brand, ' ')) AS t, lpad(cast(p_size AS varchar(10)), 4, '0') AS lp, rpad(p_type, 9, '.') AS rp, reverse(p_type) AS r, replace(p_brand, 'Brand#', 'B') AS rep, cast(length(p_name) AS int) AS n, left(p_name, 3) AS l3, right(p_name, 2) AS r2, split_part(p_name, ' ', 2) AS sp, cast(position('e' IN p_name) AS int) AS pos, repeat('ab', 2) AS rt, concat_ws('-', p_type, p_brand) AS cw, cast(ascii(p_type) AS int) AS a, chr(65 + p_size % 26) AS ch, translate(p_type, 'AO', '40') AS tr FROM part",
    "fn_regex": "SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS num, (p_name LIKE 'b%t') AS m FROM part",
    "fn_hash": "SELECT c_custkey, md5(c_name) AS h, substring(md5(c_mktsegment), 1, 8) AS s FROM customer",
    "fn_fuzzy": "SELECT a.p_type AS x, b.p_type AS y, cast(levenshtein(a.p_type, b.p_type) AS int) AS d FROM (SELECT DISTINCT p_type FROM part) a CROSS JOIN (SELECT DISTINCT p_type FROM part) b",
    "fn_date": "SELECT o_orderkey, cast(extract(year FROM o_orderdate) AS int) AS y, cast(extract(month FROM o_orderdate) AS int) AS m, cast(date_trunc('month', o_orderdate) AS date) AS mo, cast(make_date(1999, 12, 31) AS date) AS md, cast(cast(o_orderdate AS date) + interval '3' month AS date) AS plus3 FROM orders",
    "fn_math": "SELECT p_partkey, abs(p_size - 25) AS a, cast(ceil(p_retailprice) AS bigint) AS c, cast(floor(p_retailprice) AS bigint) AS f, round(sqrt(p_size), 6) AS s, round(power(p_size, 2), 2) AS p, round(ln(p_size), 6) AS l, round(exp(p_size / 50.0), 6) AS e, cast(sign(p_size - 25) AS int) AS sg, round(cbrt(p_size), 6) AS cb, p_size % 7 AS m, round(sinh(p_size / 50.0), 6) AS sh, round(atan2(p_size, 3), 6) AS at, round(degrees(0.5), 6) AS dg FROM part",
    "fn_bits": "SELECT n_nationkey, n_nationkey & 6 AS a, n_nationkey | 8 AS o, cast(bit_count(n_nationkey) AS int) AS b FROM nation",
    "fn_null": "SELECT nullif(n_regionkey, 2) AS a, coalesce(nullif(n_regionkey, 2), -1) AS b, nullif(n_regionkey, 2) IS NULL AS c FROM nation",
    # workload queries on the stand-in tables, exact
    "workload_flight_exact": "SELECT count(*) AS y FROM events WHERE event_type = 'error' AND ts >= date '2024-01-05' AND ts < date '2024-01-21'",
    "workload_intel_exact": "SELECT count(*) AS y FROM events WHERE value > 27 AND ts >= date '2024-01-03' AND ts < date '2024-01-25'",
    "workload_census_exact": "SELECT count(*) AS y FROM part WHERE p_type = 'PROMO' AND p_size >= 10 AND p_size < 40",
    "workload_ndv_exact": "SELECT count(*) AS y, count(DISTINCT cast(ts AS date)) AS ndv FROM events WHERE event_type = 'error'",
}

#: Queries with a text for each engine.
PAIRS: dict[str, tuple[str, str]] = {
    "ilike": ("SELECT count(*) AS n FROM part WHERE p_type ILIKE 'promo'", "SELECT count(*) AS n FROM part WHERE p_type ILIKE 'promo'"),
    "agg_order_by": (
        "SELECT n_regionkey, array_join(transform(array_sort(collect_list(struct(n_nationkey, n_name))), x -> x.n_name), ',') AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey",
    ),
    "mode": ("SELECT mode() WITHIN GROUP (ORDER BY k) AS m FROM (SELECT CASE WHEN n_nationkey < 9 THEN 4 ELSE n_nationkey END AS k FROM nation) t", "SELECT mode(k) AS m FROM (SELECT CASE WHEN n_nationkey < 9 THEN 4 ELSE n_nationkey END AS k FROM nation) t"),
    "series": ("SELECT explode(sequence(1, 20, 3)) AS g", "SELECT CAST(g AS INTEGER) AS g FROM generate_series(1, 20, 3) t(g)"),
    "with_ordinality": ("SELECT pos + 1 AS ord, w FROM (SELECT posexplode(array('x', 'y', 'z')) AS (pos, w))", "SELECT CAST(i AS INTEGER) AS ord, ['x', 'y', 'z'][i] AS w FROM range(1, 4) t(i)"),
    "unnest": ("SELECT p_partkey, w FROM part LATERAL VIEW explode(split(p_name, ' ')) v AS w", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part"),
    "array_functions": (
        "SELECT n_nationkey, size(array(n_nationkey, n_regionkey, 3)) AS n, array_contains(array(n_nationkey, 3), 3) AS c, element_at(array(n_nationkey, n_regionkey), 2) AS e, arrays_overlap(array(n_nationkey), array(1, 2, 3)) AS o FROM nation",
        "SELECT n_nationkey, CAST(3 AS INTEGER) AS n, list_contains([n_nationkey, 3], 3) AS c, [n_nationkey, n_regionkey][2] AS e, list_has_any([n_nationkey], [1, 2, 3]) AS o FROM nation",
    ),
    "map_functions": ("SELECT n_nationkey, element_at(map('k', n_name, 'r', cast(n_regionkey AS string)), 'r') AS r FROM nation", "SELECT n_nationkey, CAST(n_regionkey AS VARCHAR) AS r FROM nation"),
    "json_functions": ("SELECT event_id, cast(get_json_object(props, '$.k') AS int) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"),
    "encode_functions": ("SELECT n_nationkey, hex(n_name) AS h, base64(cast(n_name AS binary)) AS b FROM nation", "SELECT n_nationkey, hex(n_name) AS h, to_base64(CAST(n_name AS BLOB)) AS b FROM nation"),
    "sha2_functions": ("SELECT n_nationkey, sha2(n_name, 256) AS h FROM nation", "SELECT n_nationkey, sha256(n_name) AS h FROM nation"),
    "pivot": ("SELECT * FROM (SELECT o_orderstatus AS s, o_orderpriority AS p FROM orders) PIVOT (count(*) FOR s IN ('F' AS f, 'O' AS o, 'P' AS pp))", "SELECT o_orderpriority AS p, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS pp FROM orders GROUP BY o_orderpriority"),
    "hierarchy": (
        "WITH RECURSIVE t(id, lvl) AS (SELECT cast(1 AS bigint), 0 UNION ALL SELECT o.o_custkey, lvl + 1 FROM t JOIN (SELECT DISTINCT o_custkey, pmod(o_custkey, 37) AS parent FROM orders) o ON o.parent = t.id WHERE lvl < 2 AND o.o_custkey > t.id) SELECT lvl, count(*) AS n FROM t GROUP BY lvl",
        "WITH RECURSIVE t(id, lvl) AS (SELECT CAST(1 AS BIGINT), 0 UNION ALL SELECT o.o_custkey, lvl + 1 FROM t JOIN (SELECT DISTINCT o_custkey, o_custkey % 37 AS parent FROM orders) o ON o.parent = t.id WHERE lvl < 2 AND o.o_custkey > t.id) SELECT lvl, count(*) AS n FROM t GROUP BY lvl",
    ),
    "date_minus_date": ("SELECT o_orderkey, datediff(cast(o_orderdate AS date), date '1995-01-01') AS d, datediff(cast(o_orderdate AS date), date '1970-01-01') + 2440588 AS j FROM orders", "SELECT o_orderkey, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS d, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 2440588 AS INTEGER) AS j FROM orders"),
    "to_char": ("SELECT o_orderkey, date_format(o_orderdate, 'yyyy/MM/dd') AS d FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS d FROM orders"),
    "format_overlay": ("SELECT n_nationkey, format_string('%s-%05d', n_name, n_nationkey) AS f, overlay(n_name PLACING 'xx' FROM 2 FOR 3) AS o FROM nation", "SELECT n_nationkey, printf('%s-%05d', n_name, n_nationkey) AS f, substr(n_name, 1, 1) || 'xx' || substr(n_name, 5) AS o FROM nation"),
    "initcap": ("SELECT r_regionkey, initcap(r_name) AS i FROM region", "SELECT r_regionkey, array_to_string(list_transform(string_split(r_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS i FROM region"),
    "uniform_hash_blocks": ("SELECT l_orderkey % 100 AS b, count(*) AS n FROM lineitem WHERE cast(conv(substr(md5(cast(l_orderkey AS string)), 1, 8), 16, 10) AS bigint) % 100000 < 5000 GROUP BY l_orderkey % 100", "SELECT l_orderkey % 100 AS b, count(*) AS n FROM lineitem WHERE CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 100000 < 5000 GROUP BY l_orderkey % 100"),
    "xml_functions": ("SELECT n_nationkey, xpath_string(concat('<a><b>', n_name, '</b></a>'), 'a/b') AS b FROM nation", "SELECT n_nationkey, n_name AS b FROM nation"),
    "collation": ("SELECT count(*) AS n FROM part WHERE p_type COLLATE UTF8_LCASE = 'promo'", "SELECT count(*) AS n FROM part WHERE lower(p_type) = 'promo'"),
    "json_agg": ("SELECT n_regionkey, to_json(array_sort(collect_list(n_nationkey))) AS j FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, '[' || string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) || ']' AS j FROM nation GROUP BY n_regionkey"),
    "interval_sum": ("SELECT n_regionkey, cast(extract(DAY FROM sum(make_dt_interval(n_nationkey))) AS bigint) AS d FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(sum(n_nationkey) AS BIGINT) AS d FROM nation GROUP BY n_regionkey"),
    "fn_casts": (f"SELECT o_orderkey, {compat.rounded_bigint('o_totalprice')} AS i, cast(o_orderkey AS varchar(20)) AS s, cast('42' AS int) AS n, cast(o_orderdate AS date) AS d FROM orders", "SELECT o_orderkey, cast(o_totalprice AS bigint) AS i, cast(o_orderkey AS varchar(20)) AS s, cast('42' AS int) AS n, cast(o_orderdate AS date) AS d FROM orders"),
    "user_aggregate": ("SELECT n_regionkey, aggregate(array_sort(collect_list(n_nationkey)), cast(0 AS bigint), (acc, x) -> acc * 31 + x) AS h FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, list_reduce(list_prepend(CAST(0 AS BIGINT), list(CAST(n_nationkey AS BIGINT) ORDER BY n_nationkey)), lambda acc, x: acc * 31 + x) AS h FROM nation GROUP BY n_regionkey"),
    "min_max_index": ("SELECT min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem", "SELECT min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem"),
    "array_set_operations": ("SELECT n_nationkey, array_sort(array_intersect(array(n_nationkey, 1, 2), array(1, 2, 3))) AS i, size(array_union(array(n_nationkey), array(1, 2))) AS u FROM nation", "SELECT n_nationkey, list_sort(list_intersect([n_nationkey, 1, 2], [1, 2, 3])) AS i, CAST(len(list_distinct([n_nationkey, 1, 2])) AS INTEGER) AS u FROM nation"),
    "sql_function": ("SELECT driftgauge_twice(o_totalprice) AS t FROM orders", "SELECT o_totalprice * 2 AS t FROM orders"),
    "prepared": ("SELECT count(*) AS n FROM orders WHERE o_totalprice > :least", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 250000"),
}


def _t(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: tables.load(spark, sf_dir, name)


def _gap_distinct_on(spark: SparkSession, sf: str) -> DataFrame:
    return compat.distinct_on(_t("orders")(spark, sf).select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])


def _gap_with_ties(spark: SparkSession, sf: str) -> DataFrame:
    return compat.with_ties(_t("part")(spark, sf).select("p_partkey", "p_size"), 7, ["p_size"], descending=True)


def _gap_groups_frame(spark: SparkSession, sf: str) -> DataFrame:
    return compat.groups_frame(_t("part")(spark, sf).select("p_partkey", "p_brand", "p_size"), F.col("p_size"), ["p_brand"], "p_size", 1, 1, "s")


def _gap_exclude(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    return _t("supplier")(spark, sf).select("s_suppkey", F.round(compat.exclude_current(F.col("s_acctbal"), w, 2, 2), 4).alias("s"))


def _gap_similar(spark: SparkSession, sf: str) -> DataFrame:
    return _t("part")(spark, sf).where(compat.similar_to(F.col("p_name"), "(blue|red)%(t|r)")).select("p_partkey")


def _gap_symmetric(spark: SparkSession, sf: str) -> DataFrame:
    return _t("part")(spark, sf).where(compat.between_symmetric(F.col("p_size"), F.lit(20), F.lit(10))).select("p_partkey")


def _gap_hypothetical(spark: SparkSession, sf: str) -> DataFrame:
    return compat.hypothetical_rank(_t("customer")(spark, sf), F.col("c_acctbal"), F.lit(5000.0), ["c_mktsegment"])


def _gap_gcd_lcm(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("p_size"), F.lit(36)
    return _t("part")(spark, sf).select("p_partkey", compat.gcd(a, b).alias("g"), compat.lcm(a, b).alias("l"))


def _gap_degrees(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("p_size") * 15
    return _t("part")(spark, sf).select("p_partkey", F.round(compat.sind(x) + 0.0, 9).alias("s"), F.round(compat.cosd(x) + 0.0, 9).alias("c"))


def _gap_justify(spark: SparkSession, sf: str) -> DataFrame:
    i = compat.justify_days(compat.make_interval(F.lit(1), F.col("p_size") * 3, F.lit(0)))
    return _t("part")(spark, sf).select("p_partkey", i["months"].alias("m"), i["days"].alias("d"))


def _gap_num_nulls(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.nullif("n_regionkey", F.lit(1)), F.nullif("n_nationkey", F.lit(6))
    return _t("nation")(spark, sf).select("n_nationkey", compat.num_nulls(a, b).alias("nn"), compat.num_nonnulls(a, b).alias("no"))


def _gap_array_agg_nulls(spark: SparkSession, sf: str) -> DataFrame:
    agg = compat.array_agg(F.nullif(F.col("n_nationkey") % 4, F.lit(1)))
    return _t("nation")(spark, sf).groupBy("n_regionkey").agg(F.size(agg).alias("n"), F.size(F.filter(agg, lambda x: x.isNull())).alias("nulls"))


def _gap_replace_first(spark: SparkSession, sf: str) -> DataFrame:
    return _t("part")(spark, sf).select("p_partkey", compat.regexp_replace_first(F.col("p_name"), "[aeiou]", "*").alias("r"))


def _gap_nulls_largest(spark: SparkSession, sf: str) -> DataFrame:
    t = _t("nation")(spark, sf).select(F.nullif("n_regionkey", F.lit(3)).alias("k"), "n_nationkey")
    return t.orderBy(compat.nulls_largest(F.col("k"), True), "n_nationkey").limit(8)


def _gap_char_padding(spark: SparkSession, sf: str) -> DataFrame:
    return _t("part")(spark, sf).select("p_partkey", compat.char_n(F.col("p_type"), 10).alias("c"), compat.char_equal(compat.char_n(F.col("p_type"), 10), F.lit("PROMO")).alias("e"))


def _gap_quote(spark: SparkSession, sf: str) -> DataFrame:
    return _t("part")(spark, sf).select("p_partkey", compat.quote_ident(F.col("p_brand")).alias("i"), compat.quote_literal(F.lit("it's")).alias("l"), compat.quote_nullable(F.nullif("p_type", F.lit("PROMO"))).alias("n"))


def _gap_lock_step(spark: SparkSession, sf: str) -> DataFrame:
    t = _t("region")(spark, sf).select("r_regionkey")
    return compat.lock_step(t, a=F.array(F.lit(1), F.lit(2), F.lit(3)), b=F.array(F.lit("x"), F.lit("y")))


def _gap_ranges(spark: SparkSession, sf: str) -> DataFrame:
    r = compat.make_range(F.lit(5), F.lit(20))
    other = compat.make_range(F.col("p_size"), F.col("p_size") + 10)
    return _t("part")(spark, sf).select("p_partkey", compat.range_contains(r, F.col("p_size")).alias("c"), compat.range_overlaps(r, other).alias("o"))


def _gap_erf(spark: SparkSession, sf: str) -> DataFrame:
    """erf against its series, and erf_inv as what erf takes back, to six and four digits."""
    x, p = F.col("p_size") / 25.0, F.col("p_size") / 51.0
    return _t("part")(spark, sf).select("p_partkey", F.round(stats.erf_column(x), 6).alias("e"), F.round(stats.erf_column(stats.erf_inv_column(p)), 4).alias("i"))


def _gap_unaccent(spark: SparkSession, sf: str) -> DataFrame:
    return _t("region")(spark, sf).select("r_regionkey", compat.unaccent(F.concat(F.col("r_name"), F.lit("éüñÀ"))).alias("u"))


def _gap_materialized_view(spark: SparkSession, sf: str) -> DataFrame:
    from driftgauge.sources.views import MaterializedView

    register = tables.register_views
    register(spark, sf)
    view = MaterializedView(spark, "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey")
    view.refresh()
    return view.read()


def _python_function(spark: SparkSession, sf: str) -> DataFrame:
    @F.pandas_udf("double")
    def weighted(size: pd.Series, price: pd.Series) -> pd.Series:
        return size * 2 + price

    return _t("part")(spark, sf).select("p_partkey", weighted("p_size", "p_retailprice").alias("w"))


def _approximate_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """The exact number, and whether the estimate is within five times its standard error."""
    near = F.abs(F.approx_count_distinct("l_partkey", 0.02) - F.count_distinct("l_partkey")) <= 0.1 * F.count_distinct("l_partkey")
    return _t("lineitem")(spark, sf).agg(F.count_distinct("l_partkey").alias("n"), near.alias("near"))


def _random_order(spark: SparkSession, sf: str) -> DataFrame:
    """Ten random orders: how many, how many of them differ, and whether all are orders."""
    drawn = _t("orders")(spark, sf).orderBy(F.rand(5)).limit(10).select("o_orderkey")
    met = drawn.join(_t("orders")(spark, sf), "o_orderkey")
    return met.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("different"))


def _erf_oracle(terms: int = 60) -> str:
    """The Maclaurin series of erf, whose terms follow from each other."""
    x = "(p_size / 25.0::DOUBLE)"
    term = f"pow(-1, n) * pow({x}, 2 * n + 1) / (factorial(CAST(n AS INTEGER))::DOUBLE * (2 * n + 1))"
    return f"SELECT p_partkey, round(e, 6) AS e, round(p_size / 51.0::DOUBLE, 4) AS i FROM (SELECT p_partkey, p_size, 2 / sqrt(pi()) * sum({term} ORDER BY n) AS e FROM part, range({terms}) r(n) WHERE n <= 30 GROUP BY ALL)"


#: Rewrites of what Spark lacks, and the operator itself for the oracle.
GAPS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "distinct_on": (_gap_distinct_on, "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey"),
    "fetch_with_ties": (_gap_with_ties, "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 7"),
    "groups_frame": (_gap_groups_frame, "SELECT p_partkey, p_brand, p_size, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM part"),
    "exclude_current_row": (_gap_exclude, "SELECT s_suppkey, round(sum(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW), 4) AS s FROM supplier"),
    "similar_to": (_gap_similar, "SELECT p_partkey FROM part WHERE p_name SIMILAR TO '(blue|red).*(t|r)'"),
    "between_symmetric": (_gap_symmetric, "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20"),
    "hypothetical_rank": (_gap_hypothetical, "SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal < 5000) + 1 AS rank FROM customer GROUP BY c_mktsegment"),
    "gcd_lcm": (_gap_gcd_lcm, "SELECT p_partkey, CAST(gcd(p_size, 36) AS BIGINT) AS g, CAST(lcm(p_size, 36) AS BIGINT) AS l FROM part"),
    "degree_trigonometry": (_gap_degrees, "SELECT p_partkey, round(sin(radians(p_size * 15)), 9) + 0.0 AS s, round(cos(radians(p_size * 15)), 9) + 0.0 AS c FROM part"),
    "justify_days": (_gap_justify, "SELECT p_partkey, CAST(1 + (p_size * 3) // 30 AS INTEGER) AS m, CAST((p_size * 3) % 30 AS INTEGER) AS d FROM part"),
    "num_nulls": (_gap_num_nulls, "SELECT n_nationkey, CAST(n_regionkey = 1 AS INTEGER) + CAST(n_nationkey = 6 AS INTEGER) AS nn, 2 - CAST(n_regionkey = 1 AS INTEGER) - CAST(n_nationkey = 6 AS INTEGER) AS no FROM nation"),
    "array_agg_nulls": (_gap_array_agg_nulls, "SELECT n_regionkey, CAST(len(array_agg(nullif(n_nationkey % 4, 1))) AS INTEGER) AS n, CAST(count(*) FILTER (WHERE n_nationkey % 4 = 1) AS INTEGER) AS nulls FROM nation GROUP BY n_regionkey"),
    "regexp_replace_first": (_gap_replace_first, "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '*') AS r FROM part"),
    "nulls_largest": (_gap_nulls_largest, "SELECT nullif(n_regionkey, 3) AS k, n_nationkey FROM nation ORDER BY k DESC NULLS FIRST, n_nationkey LIMIT 8"),
    "char_padding": (_gap_char_padding, "SELECT p_partkey, rpad(p_type, 10, ' ') AS c, p_type = 'PROMO' AS e FROM part"),
    "quoting": (_gap_quote, "SELECT p_partkey, '\"' || p_brand || '\"' AS i, '''it''''s''' AS l, CASE WHEN p_type = 'PROMO' THEN 'NULL' ELSE '''' || p_type || '''' END AS n FROM part"),
    "lock_step_srf": (_gap_lock_step, "SELECT r_regionkey, a, b FROM region, (VALUES (1, 'x'), (2, 'y'), (3, NULL)) v(a, b)"),
    "range_type": (_gap_ranges, "SELECT p_partkey, p_size >= 5 AND p_size < 20 AS c, p_size < 20 AND p_size + 10 > 5 AS o FROM part"),
    "erf_functions": (_gap_erf, _erf_oracle()),
    "unaccent": (_gap_unaccent, "SELECT r_regionkey, strip_accents(r_name || 'éüñÀ') AS u FROM region"),
    "python_function": (_python_function, "SELECT p_partkey, p_size * 2 + p_retailprice AS w FROM part"),
    "approximate_distinct": (_approximate_distinct, "SELECT count(DISTINCT l_partkey) AS n, true AS near FROM lineitem"),
    "random_order": (_random_order, "SELECT CAST(10 AS BIGINT) AS n, CAST(10 AS BIGINT) AS different"),
    "materialized_view": (_gap_materialized_view, "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey"),
}


def _sql(text: str, name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables.register_views(spark, sf_dir, text)
        if name == "sql_function":
            spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION driftgauge_twice(x DOUBLE) RETURNS DOUBLE RETURN x * 2")
        return spark.sql(text, args={"least": 250_000}) if name == "prepared" else spark.sql(text)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f"sql_{n}": _sql(text, n) for n, text in SHARED.items()}
    found |= {f"sql_{n}": _sql(pair[0], n) for n, pair in PAIRS.items()}
    return found | {f"gap_{n}": fn for n, (fn, _) in GAPS.items()}


def oracle_sql() -> dict[str, str]:
    found = {f"sql_{n}": text for n, text in SHARED.items()} | {f"sql_{n}": pair[1] for n, pair in PAIRS.items()}
    return found | {f"gap_{n}": text for n, (_, text) in GAPS.items() if text}
