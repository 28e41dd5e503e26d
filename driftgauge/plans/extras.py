"""Queries of types, functions and plan nodes that Spark has no operator for, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgauge import tables
from driftgauge.conf import AqpConf
from driftgauge.functions import bits, compat, hashes, textsearch, values
from driftgauge.operators import samplers
from driftgauge.operators.estimators import Agg
from driftgauge.operators.rank_index import append, build_rank_index
from driftgauge.plans import tpch
from driftgauge.plans.cursor import Cursor
from driftgauge.sources.bucketed import BucketedTable
from driftgauge.sources.custom import custom_scan, series_provider
from driftgauge.sources.files import derby_archive, read_jdbc
from driftgauge.store import write_once
from driftgauge.streaming.online import OnlineAggregator

_load = tables.load


def bit_strings(spark: SparkSession, sf: str) -> DataFrame:
    a, b = bits.bits_of(F.col("n_nationkey"), 8), bits.bits_of(F.col("n_regionkey") * 11, 8)
    return _load(spark, sf, "nation").select(
        "n_nationkey", bits.bit_and(a, b).alias("a"), bits.bit_or(a, b).alias("o"), bits.bit_xor(a, b).alias("x"), bits.bit_not(a).alias("n"), bits.shift_left(a, 2).alias("l"), bits.shift_right(a, 1).alias("r"),
        bits.get_bit(a, 6).alias("g"), bits.set_bit(a, 0, 1).alias("s"), bits.bit_count(a).cast("long").alias("c"), bits.bits_to_long(a).alias("v"), bits.hex_to_long(F.substring(F.md5("n_name"), 1, 15)).alias("h"),
    )


_BITS_SQL = """
WITH b AS (SELECT n_nationkey, n_name, lpad(bin(n_nationkey), 8, '0') AS a, lpad(bin(n_regionkey * 11), 8, '0') AS b FROM nation)
SELECT n_nationkey, CAST(a::BIT & b::BIT AS VARCHAR) AS a, CAST(a::BIT | b::BIT AS VARCHAR) AS o, CAST(xor(a::BIT, b::BIT) AS VARCHAR) AS x, CAST(~(a::BIT) AS VARCHAR) AS n, CAST(a::BIT << 2 AS VARCHAR) AS l, CAST(a::BIT >> 1 AS VARCHAR) AS r,
get_bit(a::BIT, 6) AS g, CAST(set_bit(a::BIT, 0, 1) AS VARCHAR) AS s, CAST(bit_count(a::BIT) AS BIGINT) AS c, CAST(n_nationkey AS BIGINT) AS v, CAST('0x' || substr(md5(n_name), 1, 15) AS BIGINT) AS h FROM b"""


def hash_functions(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    return _load(spark, sf, "orders").select("o_orderkey", hashes.hash_int4(key % 100_000).alias("h4"), hashes.hash_int8(key * 1_000_003 - 7_000_000_000).alias("h8"), F.pmod(hashes.hash_int4(key % 100_000), F.lit(8)).alias("part"))


def _hash_sql() -> str:
    wide = "(o_orderkey * 1000003 - 7000000000)"
    low, high = f"({wide} & 4294967295)", f"(({wide} >> 32) & 4294967295)"
    h4 = hashes.mix_sql("(o_orderkey % 100000)")
    return f"SELECT o_orderkey, {h4} AS h4, {hashes.mix_sql(f'xor({low}, CASE WHEN {wide} >= 0 THEN {high} ELSE xor({high}, 4294967295) END)')} AS h8, ({h4} % 8 + 8) % 8 AS part FROM orders"


def text_search(spark: SparkSession, sf: str) -> DataFrame:
    vector = textsearch.to_tsvector(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    return _load(spark, sf, "part").select("p_partkey", vector.alias("__v")).select(
        "p_partkey", textsearch.ts_length(F.col("__v")).alias("n"),
        textsearch.matches(F.col("__v"), "blue & !promo").alias("a"), textsearch.matches(F.col("__v"), "re:* | (small & brand)").alias("b"), textsearch.matches(F.col("__v"), "promo <-> brand").alias("c"),
        F.round(textsearch.occurrence_rank(F.col("__v"), ["blue", "brand"]), 6).alias("r"),
    )


_SEARCH_SQL = """
WITH w AS (SELECT p_partkey, list_filter(string_split_regex(lower(concat_ws(' ', p_name, p_type, p_brand)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM part)
SELECT p_partkey, CAST(len(list_distinct(w)) AS INTEGER) AS n, list_contains(w, 'blue') AND NOT list_contains(w, 'promo') AS a,
len(list_filter(w, lambda x: starts_with(x, 're'))) > 0 OR (list_contains(w, 'small') AND list_contains(w, 'brand')) AS b,
array_to_string(w, ' ') SIMILAR TO '(.* )?promo brand( .*)?' AS c,
round(len(list_filter(w, lambda x: x IN ('blue', 'brand'))) / greatest(len(w), 1), 6) AS r FROM w"""


def networks(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("10.1."), (F.col("c_custkey") % 300).cast("string"), F.lit("."), F.col("c_nationkey").cast("string"), F.lit("/"), (16 + F.col("c_custkey") % 18).cast("string"))
    i, outer = values.inet(text), values.inet(F.lit("10.1.64.0/18"))
    return _load(spark, sf, "customer").select("c_custkey", values.host(i).alias("h"), values.masklen(i).alias("m"), values.network(i).alias("n"), values.broadcast_address(i).alias("b"), F.when(i.isNotNull(), values.contained_or_equal(i, outer)).alias("inside"))


_NETWORK_SQL = """
WITH p AS (SELECT c_custkey, c_custkey % 300 AS x, c_nationkey AS y, CAST(16 + c_custkey % 18 AS INTEGER) AS m FROM customer),
v AS (SELECT c_custkey, CASE WHEN x < 256 AND m <= 32 THEN (10 * 256 + 1) * 65536 + x * 256 + y END AS a, m FROM p),
t AS (SELECT c_custkey, a, CASE WHEN a IS NOT NULL THEN m END AS m, a - a % (1::BIGINT << (32 - least(m, 32))) AS lo, a - a % (1::BIGINT << (32 - least(m, 32))) + (1::BIGINT << (32 - least(m, 32))) - 1 AS hi FROM v),
d AS (SELECT *, concat_ws('.', a >> 24, (a >> 16) & 255, (a >> 8) & 255, a & 255) AS ta, concat_ws('.', lo >> 24, (lo >> 16) & 255, (lo >> 8) & 255, lo & 255) AS tl, concat_ws('.', hi >> 24, (hi >> 16) & 255, (hi >> 8) & 255, hi & 255) AS th FROM t)
SELECT c_custkey, CASE WHEN a IS NOT NULL THEN ta END AS h, m, CASE WHEN a IS NOT NULL THEN tl || '/' || m END AS n, CASE WHEN a IS NOT NULL THEN th || CASE WHEN m < 32 THEN '/' || m ELSE '' END END AS b,
CASE WHEN a IS NOT NULL THEN m >= 18 AND a - a % 16384 = (10 * 256 + 1) * 65536 + 64 * 256 END AS inside FROM d"""


def money_and_enums(spark: SparkSession, sf: str) -> DataFrame:
    amount = values.money(F.concat(F.when(F.col("s_acctbal") < 0, F.lit("-")).otherwise(F.lit("")), F.lit("$"), F.format_number(F.abs("s_acctbal"), 2)))
    order = ["low", "mid", "high"]
    band = F.when(F.col("s_acctbal") > 5000, "high").when(F.col("s_acctbal") > 0, "mid").otherwise("low")
    return _load(spark, sf, "supplier").select("s_suppkey", amount.cast("double").alias("m"), values.money_text(amount).alias("t"), values.enum_place(band, order).alias("e"), band.isin(*values.enum_range(order, "mid")).alias("r"), F.length(F.uuid()).cast("int").alias("u"))


_MONEY_SQL = """
SELECT s_suppkey, round(s_acctbal, 2) AS m, CASE WHEN s_acctbal < 0 THEN '-$' ELSE '$' END || format('{:,.2f}', abs(s_acctbal)) AS t,
CASE WHEN s_acctbal > 5000 THEN 2 WHEN s_acctbal > 0 THEN 1 ELSE 0 END AS e, s_acctbal > 0 AS r, 36 AS u FROM supplier"""


def geometry(spark: SparkSession, sf: str) -> DataFrame:
    p, q = values.point(F.col("p_size"), F.col("p_size") % 7), values.point(F.lit(20), F.lit(3))
    b, c = values.box(p, values.point(F.col("p_size") - 10, F.lit(9))), values.box(values.point(F.lit(15), F.lit(8)), values.point(F.lit(25), F.lit(2)))
    return _load(spark, sf, "part").select(
        "p_partkey", F.round(values.point_distance(p, q), 9).alias("d"), values.box_area(b).alias("a"), values.box_contains(b, q).alias("c"), values.box_overlaps(b, c).alias("o"), values.box_center(b)["x"].alias("x"),
        F.round(values.earth_distance(F.col("p_size"), F.lit(10.0), F.lit(48.0), F.col("p_size") * 3), 3).alias("e"),
    )


_GEOMETRY_SQL = f"""
SELECT p_partkey, round(sqrt(pow(p_size - 20, 2) + pow(p_size % 7 - 3, 2)), 9) AS d, CAST(10 * (9 - p_size % 7) AS DOUBLE) AS a, p_size - 10 <= 20 AND p_size >= 20 AND p_size % 7 <= 3 AS c,
p_size - 10 <= 25 AND p_size >= 15 AND p_size % 7 <= 8 AND 2 <= 9 AS o, p_size - 5.0::DOUBLE AS x,
round(2 * {values.EARTH_RADIUS} * asin(sqrt(pow(sin(radians(48 - p_size) / 2), 2) + cos(radians(p_size)) * cos(radians(48)) * pow(sin(radians(p_size * 3 - 10) / 2), 2))), 3) AS e FROM part"""


def moving_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy("p_brand").orderBy("p_partkey")
    size = F.nullif("p_size", F.lit(7)).cast("long")
    return _load(spark, sf, "part").select("p_partkey", compat.moving_sum(size, by, 5).alias("s"))


def int_arrays(spark: SparkSession, sf: str) -> DataFrame:
    groups = _load(spark, sf, "part").groupBy("p_brand").agg(values.int_array_aggregate(F.col("p_size")).alias("sizes"))
    return groups.select("p_brand", values.int_array_enum(F.col("sizes")).alias("size"))


def cursor_steps(spark: SparkSession, sf: str) -> DataFrame:
    """FETCH 5, MOVE 3, FETCH 4, FETCH BACKWARD 2, FETCH ABSOLUTE -1, in this order."""
    c = Cursor(_load(spark, sf, "customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"])
    found = c.fetch(5)
    c.move(3)
    found += [*c.fetch(4), *c.fetch(-2), c.fetch_absolute(-1)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(found)], "step long, c_custkey long, c_name string")


_CURSOR_SQL = """
WITH r AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_name, c_custkey) AS p, count(*) OVER () AS n FROM customer),
s AS (SELECT unnest([1, 2, 3, 4, 5, 9, 10, 11, 12, 11, 10, -1]) AS p, unnest(range(12)) AS step)
SELECT step, c_custkey, c_name FROM s JOIN r ON r.p = CASE WHEN s.p < 0 THEN n + 1 + s.p ELSE s.p END"""


def partitionwise_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    orders = BucketedTable(_load(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderkey"], 8)
    lines = BucketedTable(_load(spark, sf, "lineitem").select("l_orderkey", "l_quantity"), ["l_orderkey"], 8)
    return orders.read(), lines.read()


def partitionwise_join(spark: SparkSession, sf: str) -> DataFrame:
    """A join of two tables bucketed on its key: each bucket is joined where it lies."""
    orders, lines = partitionwise_tables(spark, sf)
    return orders.hint("merge").join(lines, orders.o_orderkey == lines.l_orderkey).select("o_orderkey", "o_orderpriority", "l_quantity")


def partitionwise_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """An aggregate on the key of a bucketed table: each bucket is summed up where it lies."""
    _, lines = partitionwise_tables(spark, sf)
    return lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


def scan_provider(spark: SparkSession, sf: str) -> DataFrame:
    return custom_scan(spark, series_provider(1000, 64), 100, 900).where("n % 3 = 0")


def single_key(spark: SparkSession, sf: str) -> DataFrame:
    """Progressive sampling of one key value: one phase without strata, whatever the strategy, and the exact count it comes to."""
    idx = tpch.index(spark, sf, "part", "p_size")
    found = OnlineAggregator(idx, AqpConf(optimization_strategy=2)).run({"y": Agg("count_star")}, 2000, 500, rel_error=0.05, ranges={"p_size": (20, 21)}, predicate=F.lit(True), seed=3)
    rows = _load(spark, sf, "part").where("p_size = 20").agg(F.count("*").alias("n"))
    phases = {r.phase for r in found.rounds}
    return rows.select("n", (F.round(F.lit(found.value()[0])).cast("long") == F.col("n")).alias("exact"), F.lit(phases <= {1} and not found.strata and found.strategy == "uniform" or not found.weight).alias("one_phase"))


def hypothetical_family(spark: SparkSession, sf: str) -> DataFrame:
    t, value, of = _load(spark, sf, "customer"), F.col("c_acctbal"), F.lit(5000.0)
    out = compat.hypothetical_dense_rank(t, value, of, ["c_mktsegment"])
    out = out.join(compat.hypothetical_percent_rank(t, value, of, ["c_mktsegment"]), "c_mktsegment").join(compat.hypothetical_cume_dist(t, value, of, ["c_mktsegment"]), "c_mktsegment")
    return out.select("c_mktsegment", "dense_rank", F.round("percent_rank", 9).alias("percent_rank"), F.round("cume_dist", 9).alias("cume_dist"))


def excluded_peers(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size").cast("long")
    return _load(spark, sf, "part").select("p_partkey", compat.exclude_peers(size, ["p_brand"], ["p_type"]).alias("g"), compat.exclude_peers(size, ["p_brand"], ["p_type"], True).alias("t"))


_FRAME = "OVER (PARTITION BY p_brand ORDER BY p_type ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE"


def xml_rows(spark: SparkSession, sf: str) -> DataFrame:
    xml = F.concat(F.lit("<a>"), F.concat_ws("", *[F.concat(F.lit(f'<r k="{i}"><v>'), F.col("n_name"), F.lit(f"-{i}</v></r>")) for i in range(3)]), F.lit("</a>"))
    rows = _load(spark, sf, "nation").select("n_nationkey", F.explode(compat.xml_table(xml, "a/r", {"k": "@k", "v": "v/text()"})).alias("r"))
    return rows.select("n_nationkey", F.col("r.k").cast("int").alias("k"), F.col("r.v").alias("v"))


def appended_index(spark: SparkSession, sf: str) -> DataFrame:
    part = _load(spark, sf, "part")
    first = build_rank_index(part.where("p_partkey % 3 > 0"), "p_size", ("p_partkey",))
    return append(first, part.where("p_partkey % 3 = 0"), ("p_partkey",)).rows.select("p_partkey", "p_size", "rank")


def _index_ids(spark: SparkSession, sf: str, key: str, low: int, high: int) -> DataFrame:
    """Ids of the rows in a key range, from the index alone: a range of ranks."""
    idx = build_rank_index(_load(spark, sf, "part"), key, ("p_partkey",), columns=[key, "p_partkey"])
    lo, hi = idx.bounds((low, high))
    return idx.rows.where((F.col("rank") >= lo) & (F.col("rank") < hi)).select("p_partkey")


def index_scans(spark: SparkSession, sf: str) -> DataFrame:
    """Two index scans, whose row ids are met (AND) or put together (OR) before the table is read."""
    size, key = _index_ids(spark, sf, "p_size", 10, 20), _index_ids(spark, sf, "p_partkey", 1, 200)
    table = _load(spark, sf, "part").select("p_partkey", "p_brand")
    return table.join(size.intersect(key), "p_partkey", "left_semi").withColumn("kind", F.lit("and")).union(table.join(size.union(key).distinct(), "p_partkey", "left_semi").withColumn("kind", F.lit("or")))


def materialized_twice(spark: SparkSession, sf: str) -> DataFrame:
    """An intermediate result that is written once and read twice."""
    totals = write_once(_load(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")), "materialize")
    most = totals.agg(F.max("n").alias("n"))
    return totals.join(F.broadcast(most), "n").select("o_custkey", "n")


def identity_column(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers 1, 2, .. in an order, from partition counts: no row passes through one task."""
    idx = build_rank_index(_load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", ("o_orderkey",))
    return idx.rows.select("o_orderkey", (F.col("rank") + 1).alias("id"))


def interval_and_enum_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    days = compat.make_interval(F.lit(0), F.col("p_size"), F.lit(0))
    order = ["SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO", "STANDARD"]
    place = values.enum_place(F.col("p_type"), order)
    total, mean = F.round(compat.sum_interval_days(days) * 86400, 2), F.round(compat.avg_interval_days(days) * 86400, 0)
    return _load(spark, sf, "part").groupBy("p_brand").agg(total.alias("s"), mean.alias("a"), F.min_by("p_type", place).alias("lo"), F.max_by("p_type", place).alias("hi"))


_ENUM = "CASE p_type WHEN 'SMALL' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'ECONOMY' THEN 3 WHEN 'PROMO' THEN 4 WHEN 'STANDARD' THEN 5 END"


def table_function(spark: SparkSession, sf: str) -> DataFrame:
    """A SQL function that returns a table, called for each row."""
    tables.register_views(spark, sf, "region nation")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION driftgauge_nations(r BIGINT) RETURNS TABLE (k BIGINT, name STRING) RETURN SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = r")
    return spark.sql("SELECT r_name, t.k, t.name FROM region, LATERAL driftgauge_nations(r_regionkey) t")


def created_table(spark: SparkSession, sf: str) -> DataFrame:
    """CREATE TABLE AS, and a view over it that hides rows."""
    made = BucketedTable(_load(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey", "c_nationkey"), ["c_custkey"], 4)
    made.read().where("c_nationkey < 10").createOrReplaceTempView("driftgauge_some_customers")
    return spark.sql("SELECT c_nationkey, count(*) AS n FROM driftgauge_some_customers GROUP BY c_nationkey")


def python_window(spark: SparkSession, sf: str) -> DataFrame:
    """A window function in Python, over Arrow batches of a partition."""

    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    return _load(spark, sf, "supplier").select("s_suppkey", F.round(spread("s_acctbal").over(Window.partitionBy("s_nationkey")), 2).alias("d"))


def foreign_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table of another database, filtered there: the embedded one that comes with Spark, as an archive that every executor opens."""
    url = derby_archive(_load(spark, sf, "nation").select("n_nationkey", "n_regionkey"), "nations")
    return read_jdbc(spark, url, "nations", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").where("n_regionkey = 2")


def time_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A sample limited in time: whether it is part of the table, without a row twice."""
    customers = _load(spark, sf, "customer")
    drawn = samplers.system_time(customers, 1500.0, ["c_custkey"], 11)
    met = drawn.select("c_custkey").join(customers.select("c_custkey"), "c_custkey", "left_anti")
    return drawn.agg((F.count("*") == F.count_distinct("c_custkey")).alias("once"), (F.count("*") <= customers.count()).alias("within")).withColumn("part", F.lit(met.isEmpty()))


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "bit_strings": (bit_strings, _BITS_SQL),
    "hash_functions": (hash_functions, _hash_sql()),
    "text_search": (text_search, _SEARCH_SQL),
    "networks": (networks, _NETWORK_SQL),
    "money_and_enums": (money_and_enums, _MONEY_SQL),
    "geometry": (geometry, _GEOMETRY_SQL),
    "moving_aggregate": (moving_aggregate, "SELECT p_partkey, CAST(sum(CASE WHEN p_size <> 7 THEN p_size END) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM part"),
    "int_arrays": (int_arrays, "SELECT p_brand, CAST(p_size AS INTEGER) AS size FROM part"),
    "cursor": (cursor_steps, _CURSOR_SQL),
    "partitionwise_join": (partitionwise_join, "SELECT o_orderkey, o_orderpriority, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey"),
    "partitionwise_aggregate": (partitionwise_aggregate, "SELECT l_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_orderkey"),
    "custom_scan": (scan_provider, "SELECT range AS n, range * range AS square FROM range(100, 900) WHERE range % 3 = 0"),
    "hypothetical_family": (hypothetical_family, "SELECT c_mktsegment, count(DISTINCT c_acctbal) FILTER (c_acctbal < 5000) + 1 AS dense_rank, round(count(*) FILTER (c_acctbal < 5000) / count(*), 9) AS percent_rank, round((count(*) FILTER (c_acctbal <= 5000) + 1) / (count(*) + 1), 9) AS cume_dist FROM customer GROUP BY c_mktsegment"),
    "exclude_peers": (excluded_peers, f"SELECT p_partkey, CAST(sum(p_size) {_FRAME} GROUP) AS BIGINT) AS g, CAST(sum(p_size) {_FRAME} TIES) AS BIGINT) AS t FROM part"),
    "xml_table": (xml_rows, "SELECT n_nationkey, CAST(range AS INTEGER) AS k, n_name || '-' || range AS v FROM nation, range(3)"),
    "appended_index": (appended_index, "SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS rank FROM part"),
    "index_scans": (index_scans, "SELECT p_partkey, p_brand, 'and' AS kind FROM part WHERE p_size >= 10 AND p_size < 20 AND p_partkey >= 1 AND p_partkey < 200 UNION ALL SELECT p_partkey, p_brand, 'or' FROM part WHERE p_size >= 10 AND p_size < 20 OR p_partkey >= 1 AND p_partkey < 200"),
    "materialize": (materialized_twice, "WITH t AS MATERIALIZED (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT * FROM t WHERE n = (SELECT max(n) FROM t)"),
    "identity_column": (identity_column, "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS id FROM orders"),
    "interval_and_enum_aggregates": (interval_and_enum_aggregates, f"SELECT p_brand, sum(p_size) * 86400.0::DOUBLE AS s, round(avg(p_size) * 86400, 0) AS a, arg_min(p_type, {_ENUM}) AS lo, arg_max(p_type, {_ENUM}) AS hi FROM part GROUP BY p_brand"),
    "table_function": (table_function, "SELECT r_name, n_nationkey AS k, n_name AS name FROM region JOIN nation ON n_regionkey = r_regionkey"),
    "created_table": (created_table, "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 0 AND c_nationkey < 10 GROUP BY c_nationkey"),
    "python_window": (python_window, "SELECT s_suppkey, round(max(s_acctbal) OVER w - min(s_acctbal) OVER w, 2) AS d FROM supplier WINDOW w AS (PARTITION BY s_nationkey)"),
    "foreign_table": (foreign_table, "SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey = 2"),
    "time_sample": (time_sample, "SELECT true AS once, true AS within, true AS part"),
    "single_key_phase": (single_key, "SELECT count(*) AS n, true AS exact, true AS one_phase FROM part WHERE p_size = 20"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"gap_{n}": fn for n, (fn, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {f"gap_{n}": sql for n, (_, sql) in QUERIES.items()}
