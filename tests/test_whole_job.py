"""Places where a result was once less than the whole."""

import os
import subprocess
import sys

import pytest
from engine_tables import SF
from pyspark.sql import functions as F

from driftgauge import tables
from driftgauge.functions import compat
from driftgauge.operators.estimators import approx_count, approx_sum
from driftgauge.operators.rank_index import build_rank_index
from driftgauge.plans import extras, surface, tpch
from driftgauge.plans.sqlfront import AqpSession
from driftgauge.streaming.online import OnlineAggregator


@pytest.fixture(scope="module")
def rare(spark):
    """20,000 rows, 10 of them rare."""
    df = spark.range(20_000).select("id", (F.col("id") % 50).alias("k"), (F.col("id") % 2000 == 7).alias("rare"))
    return df, build_rank_index(df, "k", ["id"])


def test_no_accepted_draw_is_not_settled(spark, rare):
    _, index = rare
    aggs = {"n": approx_count(), "s": approx_sum(F.col("id"))}
    # the pilot of 100 meets none of the ten rows in 20,000
    r = OnlineAggregator(index).run(aggs, 60_000, 100, rel_error=0.5, predicate=F.col("rare"), seed=1)
    n, e = r.value("n")
    assert r.rounds[0].accepted == 0 and r.draws > 100 and e > 0 and abs(n - 10) < 3 * e
    assert r.met == (e <= 0.5 * n) and r.to_df(spark).first()["met"] == r.met
    for target in ({"rel_error": 0.05}, {"abs_error": 1e9}):
        none = OnlineAggregator(index).run(aggs, 5000, 100, predicate=F.lit(False), **target)
        assert none.draws == 5000 and not none.met and none.value("n") == none.value("s") == (0.0, None)
        row = none.to_df(spark).first()
        assert (row["n"], row["n_half_ci"], row["met"]) == (0.0, None, False)


def test_group_without_accepted_draw_is_not_settled(rare):
    _, index = rare
    # even and odd ids are groups; only the even ones have common hits
    r = OnlineAggregator(index).run({"n": approx_count()}, 60_000, 500, rel_error=0.5, predicate=F.expr("rare or k % 2 = 0"), by=["odd"], seed=1, extend=lambda d: d.withColumn("odd", F.col("id") % 2))
    n, e = r.value("n", (1,))
    assert r.draws > 500 and e > 0 and abs(n - 10) < 3 * e


def test_unmet_target_shows_in_sql(spark, rare):
    df, index = rare
    s = AqpSession(spark)
    s.register("t", df, ["id"], [index])
    row = s.sql("SELECT approx_count(*) AS n, approx_count_star_half_ci(0.95) AS e FROM t TABLESAMPLE pswr(2000, 100, 0.05, 0.95) WHERE id < 0").first()
    assert (row["n"], row["e"]) == (0.0, None)


@pytest.mark.parametrize("q", ["q7", "q17"])
def test_progressive_suite_reaches_its_target(spark, q):
    """A selective walk and one with several matches, against the exact sum."""
    first = next(iter(tpch.SPECS[q].measures))
    truth = tpch.exact(q)(spark, SF).first()[first]
    row = tpch.pswr_run(spark, SF, q).to_df(spark).first()
    half = row[f"{first}_half_ci"]
    assert row["met"] and 100_000 <= row["draws"] <= tpch.PSWR_BUDGET
    assert 0 < half <= 0.05 * row[first] and abs(row[first] - truth) < 2 * half


def test_progressive_suite_is_registered():
    assert {f"tpch_q{k}_pswr" for k in range(1, 23)} <= set(tpch.queries())


def test_self_join_and_user_aggregate_are_whole(spark):
    wide = SF.replace("0.001", "0.01")  # has order keys of 2000 and more
    lines = tables.load(spark, wide, "lineitem").select("l_orderkey", "l_suppkey").toPandas()
    sizes = lines.groupby("l_orderkey").size()
    same = lines.groupby(["l_orderkey", "l_suppkey"]).size()
    assert surface.queries()["sql_join_non_equi_term"](spark, wide).first()["n"] == (sizes**2).sum() - (same**2).sum()
    expected: dict[int, int] = {}
    for r in tables.load(spark, SF, "nation").orderBy("n_nationkey").collect():
        expected[r.n_regionkey] = expected.get(r.n_regionkey, 0) * 31 + r.n_nationkey
    assert {r.n_regionkey: r.h for r in surface.queries()["sql_user_aggregate"](spark, SF).collect()} == expected


def test_casts_round_every_order(spark):
    assert [r.i for r in spark.sql(f"SELECT {compat.rounded_bigint('x')} AS i FROM VALUES (0.5D), (1.5D), (2.5D), (-1.5D), (2.6D), (-2.6D), (1e15D) AS t(x)").collect()] == [0, 2, 2, -2, 3, -3, 10**15]
    prices = {r.o_orderkey: r.o_totalprice for r in tables.load(spark, SF, "orders").collect()}
    found = {r.o_orderkey: r.i for r in surface.queries()["sql_fn_casts"](spark, SF).collect()}
    assert found == {k: round(p) for k, p in prices.items()}


_CLUSTER = """
import atexit, sys
from pyspark.sql import SparkSession
from driftgauge.plans import extras
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.checkpoint.dir", "file://" + sys.argv[1]).config("spark.executor.memory", "512m").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
atexit.register(spark.stop)
found = extras.queries()["gap_foreign_table"](spark, sys.argv[2])
rows = sorted(map(tuple, found.collect()))
from driftgauge.sources.files import derby_archive, read_jdbc
odd = read_jdbc(spark, derby_archive(spark.range(2500).selectExpr("id", "nullif(cast(id as int), 7) as k", "id / 2 as x"), "odd"), "odd")
twelve = odd
for _ in range(11):
    twelve = twelve.union(odd)
print("found", rows, found.dtypes, (twelve.count(), odd.where("k is null").first().asDict(), odd.where("x > 1249").count()))
"""


def test_foreign_table_is_read_by_every_executor(spark, tmp_path):
    """The other database once lived in the driver's JVM, and executors did not see its table."""
    here = {**os.environ, "PYTHONPATH": os.pathsep.join([os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH", "")])}
    run = subprocess.run([sys.executable, "-c", _CLUSTER, f"{tmp_path}/a folder", SF], env=here, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    nations = tables.load(spark, SF, "nation").where("n_regionkey = 2").select("n_nationkey", "n_regionkey")
    assert run.returncode == 0, run.stderr[-3000:]
    assert run.stdout.splitlines()[-1].split("found ")[-1] == f"{sorted(map(tuple, nations.collect()))} {nations.dtypes} {(30_000, {'id': 7, 'k': None, 'x': 3.5}, 1)}"
    assert not list((tmp_path / "a folder").rglob("driftgauge-*"))  # gone with the driver


def test_interval_aggregates_of_large_groups(spark, duck, tmp_path):
    """Sums of more days than an int holds as seconds, or an interval as days; a mean that SQL rounds down; null sizes and no label."""
    sizes = "CASE b WHEN 0 THEN 50 WHEN 1 THEN 2000000000 - id WHEN 2 THEN if(id < 7, 2, 1) WHEN 3 THEN if(id % 3 = 0, NULL, -id) END"
    part = spark.range(1280).selectExpr("id", "explode(sequence(0, 4)) AS b").selectExpr("concat('Brand#', b) AS p_brand", f"cast({sizes} AS int) AS p_size", "if(b = 3, 'none', element_at(array('PROMO', 'LARGE', 'other'), cast(id % 3 AS int) + 1)) AS p_type")
    part.write.parquet(f"{tmp_path}/part.parquet")
    own = duck.cursor()
    own.sql(f"CREATE TEMP VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    expected = own.sql(extras.oracle_sql()["gap_interval_and_enum_aggregates"])
    found = extras.queries()["gap_interval_and_enum_aggregates"](spark, str(tmp_path)).orderBy("p_brand")
    rows = [tuple(r) for r in found.collect()]
    assert found.columns == expected.columns and rows == sorted(expected.fetchall())
    assert rows[0][1] == 1280 * 50 * 86400 and rows[1][1] == (1280 * 2_000_000_000 - 1279 * 640) * 86400 and rows[2][2] == 86872 and rows[4][1:3] == (None, None)


def test_interval_lengths_add_up(spark):
    rows = spark.createDataFrame([(1, 40, -3_600_000_000), (0, None, 0), (2, -1, 1)], "m int, d int, u long")
    interval = compat.make_interval(F.col("m"), F.col("d"), F.col("u"))
    total, mean = rows.where("d is not null").agg(compat.sum_interval_days(interval), compat.avg_interval_days(interval)).first()
    assert total == pytest.approx(129 - 1 / 24, abs=1e-9) and mean == total / 2
