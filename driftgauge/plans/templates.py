"""The suite's full templates: grouped, nested and correlated forms with parameters.

``template(name, **values)`` gives the text for other parameters; both engines
run it. The columns are the nearest ones of the given tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge import tables
from driftgauge.plans import tpch

_VOLUME = "l_extendedprice * (1 - l_discount)"

#: name -> (text, parameters)
TEMPLATES: dict[str, tuple[str, dict[str, object]]] = {
    "q1": (f"""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum({_VOLUME}), 2) AS sum_disc_price,
       round(sum({_VOLUME} * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= date '2001-12-01' - interval '{{days}}' day GROUP BY l_returnflag, l_linestatus""", {"days": 90}),
    "q2": ("""
WITH offers AS (
  SELECT p_partkey, s_suppkey, s_name, s_acctbal, n_name, ps_supplycost
  FROM partsupp JOIN part ON p_partkey = ps_partkey JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE r_name = '{region}' AND p_size = {size} AND p_type LIKE '%{suffix}')
SELECT o.s_acctbal, o.s_name, o.n_name, o.p_partkey FROM offers o
WHERE o.ps_supplycost = (SELECT min(i.ps_supplycost) FROM offers i WHERE i.p_partkey = o.p_partkey)""", {"region": "EUROPE", "size": 15, "suffix": "O"}),
    "q3": (f"""
SELECT l_orderkey, round(sum({_VOLUME}), 2) AS revenue, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = '{{segment}}' AND o_orderdate < date '{{day}}' AND l_shipdate > date '{{day}}' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""", {"segment": "BUILDING", "day": "1998-03-15"}),
    "q4": ("""
SELECT o_orderpriority, count(*) AS order_count FROM orders
WHERE o_orderdate >= date '{day}' AND o_orderdate < date '{day}' + interval '3' month AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + interval '60' day)
GROUP BY o_orderpriority""", {"day": "1996-07-01"}),
    "q5": (f"""
SELECT n_name, round(sum({_VOLUME}), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey
JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = '{{region}}' AND o_orderdate >= date '{{day}}' AND o_orderdate < date '{{day}}' + interval '1' year GROUP BY n_name""", {"region": "ASIA", "day": "1996-01-01"}),
    "q7": (f"""
SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, cast(extract(year FROM l_shipdate) AS int) AS l_year, round(sum({_VOLUME}), 2) AS revenue
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey
WHERE ((a.n_name = '{{one}}' AND b.n_name = '{{two}}') OR (a.n_name = '{{two}}' AND b.n_name = '{{one}}')) AND l_shipdate BETWEEN date '1996-01-01' AND date '1999-12-31'
GROUP BY a.n_name, b.n_name, extract(year FROM l_shipdate)""", {"one": "NATION_3", "two": "NATION_7"}),
    "q8": (f"""
WITH v AS (SELECT extract(year FROM o_orderdate) AS y, {_VOLUME} AS volume, b.n_name AS nation FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey JOIN region ON r_regionkey = a.n_regionkey WHERE r_name = '{{region}}' AND p_type = '{{type}}')
SELECT cast(y AS int) AS o_year, round(sum(CASE WHEN nation = '{{nation}}' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM v GROUP BY y""", {"region": "EUROPE", "type": "ECONOMY", "nation": "NATION_3"}),
    "q9": (f"""
SELECT n_name AS nation, cast(extract(year FROM o_orderdate) AS int) AS o_year, round(sum({_VOLUME} - ps_supplycost * l_quantity), 2) AS sum_profit
FROM lineitem JOIN partsupp ON ps_partkey = l_partkey AND ps_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON n_nationkey = s_nationkey
WHERE p_name LIKE '%{{word}}%' GROUP BY n_name, extract(year FROM o_orderdate)""", {"word": "blue"}),
    "q10": (f"""
SELECT c_custkey, c_name, cast(sum(cast({_VOLUME} AS decimal(20, 4))) AS double) AS revenue, c_acctbal, n_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
WHERE o_orderdate >= date '{{day}}' AND o_orderdate < date '{{day}}' + interval '3' month AND l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""", {"day": "1996-01-01"}),
    "q11": ("""
WITH v AS (SELECT ps_partkey, sum(ps_supplycost * ps_availqty) AS value FROM partsupp JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_name = '{nation}' GROUP BY ps_partkey)
SELECT ps_partkey, round(value, 2) AS value FROM v WHERE value > (SELECT sum(value) * {fraction} FROM v)""", {"nation": "NATION_7", "fraction": 0.005}),
    "q12": ("""
SELECT l_linestatus AS mode, count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS high_line_count, count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS low_line_count
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate >= date '{day}' AND l_shipdate < date '{day}' + interval '1' year GROUP BY l_linestatus""", {"day": "1997-01-01"}),
    "q13": ("""
SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority NOT LIKE '{word}%' GROUP BY c_custkey) t GROUP BY c_count""", {"word": "5"}),
    "q15": (f"""
WITH r AS (SELECT l_suppkey AS supplier_no, round(sum({_VOLUME}), 2) AS total_revenue FROM lineitem WHERE l_shipdate >= date '{{day}}' AND l_shipdate < date '{{day}}' + interval '3' month GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN r ON supplier_no = s_suppkey WHERE total_revenue = (SELECT max(total_revenue) FROM r)""", {"day": "1996-01-01"}),
    "q16": ("""
SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM partsupp JOIN part ON p_partkey = ps_partkey
WHERE p_brand <> '{brand}' AND p_type NOT LIKE '{type}%' AND p_size IN (1, 4, 9, 16, 25, 36, 49) AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size""", {"brand": "Brand#12", "type": "SMALL"}),
    "q17": ("""
SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem l JOIN part ON p_partkey = l_partkey
WHERE p_brand = '{brand}' AND l_quantity < (SELECT 0.4 * avg(i.l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey)""", {"brand": "Brand#23"}),
    "q18": ("""
SELECT c_name, c_custkey, o_orderkey, o_totalprice, round(sum(l_quantity), 2) AS qty FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > {most}) GROUP BY c_name, c_custkey, o_orderkey, o_totalprice""", {"most": 250}),
    "q20": ("""
WITH sold AS (SELECT l_partkey AS k, l_suppkey AS s, 0.5 * sum(l_quantity) AS half FROM lineitem WHERE l_shipdate >= date '{day}' AND l_shipdate < date '{day}' + interval '1' year GROUP BY l_partkey, l_suppkey)
SELECT s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_name = '{nation}' AND s_suppkey IN (
  SELECT ps_suppkey FROM partsupp JOIN sold ON k = ps_partkey AND s = ps_suppkey WHERE ps_availqty > half AND ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE '{word}%'))""", {"day": "1997-01-01", "nation": "NATION_7", "word": "blue"}),
    "q21": ("""
SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem a ON a.l_suppkey = s_suppkey JOIN orders ON o_orderkey = a.l_orderkey JOIN nation ON n_nationkey = s_nationkey
WHERE o_orderstatus = 'F' AND a.l_linestatus = 'O' AND n_name = '{nation}'
  AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM lineitem c WHERE c.l_orderkey = a.l_orderkey AND c.l_suppkey <> a.l_suppkey AND c.l_linestatus = 'O') GROUP BY s_name""", {"nation": "NATION_7"}),
    "q22": ("""
SELECT c_nationkey AS cntrycode, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer c
WHERE c_nationkey IN (3, 7, 9, 13, 18) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0 AND c_nationkey IN (3, 7, 9, 13, 18))
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_totalprice > {price}) GROUP BY c_nationkey""", {"price": 300000}),
}

#: Random key ranges for accuracy runs, drawn by MD5.
RANGES, FIRST_DAY, DAYS = 50, 2_449_720, 2490


def template(name: str, **values) -> str:
    text, defaults = TEMPLATES[name]
    unknown = set(values) - set(defaults)
    if unknown:
        raise ValueError(f"{name} has no parameters {sorted(unknown)}")
    return text.format(**(defaults | values)).strip()


def query(name: str, **values) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = template(name, **values)
        tpch.register(spark, sf_dir, text)
        return spark.sql(text)

    return run


def oracle(name: str, **values) -> str:
    text = template(name, **values)
    if "partsupp" not in text:
        return text
    return f"WITH partsupp AS ({tpch.PARTSUPP}), {text[5:]}" if text.startswith("WITH ") else f"WITH partsupp AS ({tpch.PARTSUPP}) {text}"


def random_ranges(spark: SparkSession) -> DataFrame:
    """(id, lo, hi) of random ranges of ship days, hi exclusive and above lo."""
    from driftgauge.functions.draws import u32

    a, b = (FIRST_DAY + u32(1, tag, F.col("id")) % DAYS for tag in ("a", "b"))
    return spark.range(RANGES).select("id", F.least(a, b).alias("lo"), (F.greatest(a, b) + 1).alias("hi"))


def range_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and distinct days of each random range, from the index's key statistics alone."""
    stats = tpch.index(spark, sf_dir, "lineitem", "shipdate_julian").key_stats()
    ranges = random_ranges(spark)
    # fifty ranges against one row for each day
    joined = F.broadcast(ranges).join(stats, (F.col("key") >= F.col("lo")) & (F.col("key") < F.col("hi")), "left")
    return joined.groupBy("id", "lo", "hi").agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("y"), F.count("key").alias("ndv"))


def _range_oracle() -> str:
    number = lambda tag: tpch.u32_sql(f"'1|{tag}|' || CAST(range AS VARCHAR)") + f" % {DAYS}"
    return f"""
WITH r AS (SELECT range AS id, {FIRST_DAY} + {number('a')} AS a, {FIRST_DAY} + {number('b')} AS b FROM range({RANGES})),
d AS (SELECT date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + {tables.JULIAN_EPOCH} AS k FROM lineitem)
SELECT id, least(a, b) AS lo, greatest(a, b) + 1 AS hi, count(k) AS y, count(DISTINCT k) AS ndv FROM r LEFT JOIN d ON k >= least(a, b) AND k <= greatest(a, b) GROUP BY ALL"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"tpch_{n}_template": query(n) for n in TEMPLATES} | {"random_range_counts": range_counts}


def oracle_sql() -> dict[str, str]:
    return {f"tpch_{n}_template": oracle(n) for n in TEMPLATES} | {"random_range_counts": _range_oracle()}
