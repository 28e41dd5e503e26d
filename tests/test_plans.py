"""Shapes of physical plans that large tables depend on."""

import re

import pytest
from engine_tables import SF
from pyspark.sql import functions as F

from driftgauge import tables
from driftgauge.operators import matches
from driftgauge.operators.estimators import Agg, estimate
from driftgauge.operators.rank_index import build_rank_index
from driftgauge.operators.samplers import Stratum, swr, universe
from driftgauge.plans import tpch


@pytest.fixture(scope="module")
def index(spark):
    return build_rank_index(tables.lineitem(spark, SF), "shipdate_julian", tables.LINEITEM_ID)


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_fetch_prunes_and_does_not_shuffle(index):
    sample = swr(index, 500, 1, (2450084, 2450814), F.col("l_quantity") < 24)
    text = plan(estimate(sample, [Stratum(0, *index.bounds((2450084, 2450814)), 500)], {"y": Agg("sum", F.col("l_extendedprice"))}))
    assert "GreaterThanOrEqual(rank" in text and "LessThan(rank" in text
    read = re.search(r"ReadSchema: struct<([^>]*)>", text)[1]
    assert "l_comment" not in read and "l_tax" not in read and "l_quantity" in read
    assert text.count("hashpartitioning") == 1 and "BroadcastHashJoin" in text and "Python" not in text


def test_scan_pushes_filters(spark):
    text = plan(tpch.exact("q6")(spark, SF))
    assert "PushedFilters: [IsNotNull(l_shipdate)" in text and "l_tax" not in text.split("ReadSchema")[1]
    kept = plan(universe(tables.load(spark, SF, "orders").select("o_orderkey"), F.col("o_orderkey"), 0.1))
    assert "Exchange" not in kept


def test_large_tables_are_met_by_their_keys(spark, index):
    """Beyond the broadcast threshold the draws' keys go to the table, and the result is the same."""
    orders = tables.load(spark, SF, "orders")
    sample = swr(index, 300, 4)
    small = matches.lookup(sample, orders, [("l_orderkey", "o_orderkey")], draws=300)
    by_part = build_rank_index(tables.lineitem(spark, SF), "l_partkey", tables.LINEITEM_ID)
    parts = swr(build_rank_index(tables.load(spark, SF, "part"), "p_size", ["p_partkey"]), 200, 4)
    drawn = matches.random_match(parts, "p_partkey", by_part, 4, draws=200)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "1k")
        large = matches.lookup(sample, orders, [("l_orderkey", "o_orderkey")], draws=300)
        assert "LeftSemi, BuildRight" in plan(large)
        drawn_large = matches.random_match(parts, "p_partkey", by_part, 4, draws=200)
        cols = ["__draw", "o_custkey", "__accepted"]
        assert sorted(map(repr, large.select(*cols).collect())) == sorted(map(repr, small.select(*cols).collect()))
        cols = ["__draw", "l_orderkey", "__inv_prob", "__accepted"]
        assert sorted(map(repr, drawn_large.select(*cols).collect())) == sorted(map(repr, drawn.select(*cols).collect()))
    finally:
        spark.conf.set(key, before)


def test_bucketed_tables_need_no_exchange(spark):
    from driftgauge.plans import extras

    for query in (extras.partitionwise_join, extras.partitionwise_aggregate):
        df = query(spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and df.count() > 0


def test_moving_sums_take_back(spark):
    """A frame of any length is two running sums."""
    from pyspark.sql import Window

    from driftgauge.functions import compat

    df = spark.range(2000).select("id", (F.col("id") * 7 % 13).alias("v"))
    by = Window.orderBy("id")
    frame = by.rowsBetween(-499, 0)
    assert df.select((compat.moving_sum(F.col("v"), by, 500) == F.sum("v").over(frame)).alias("same")).where("not same").count() == 0
