import math

import pytest
from engine_tables import SF
from pyspark.sql import functions as F

from driftgauge import tables
from driftgauge.conf import AqpConf
from driftgauge.functions import draws
from driftgauge.functions.stats import clt_half_width, erf_column, erf_inv, erf_inv_column
from driftgauge.operators import allocate, matches, samplers
from driftgauge.operators.estimators import Agg, approx_count, approx_sum, combine_phases, estimate, inv_sample_prob, ratio, running_sample_size, sample_prob, stratum_stats
from driftgauge.operators.rank_index import build_rank_index
from driftgauge.operators.samplers import Stratum, swr, swr_strata
from driftgauge.sources.generators import high_variance_ranges, skewed_facts, zipf_int
from driftgauge.streaming.online import OnlineAggregator


@pytest.fixture(scope="module")
def index(spark):
    return build_rank_index(tables.lineitem(spark, SF), "shipdate_julian", tables.LINEITEM_ID)


@pytest.fixture(scope="module")
def skewed(spark):
    return build_rank_index(skewed_facts(spark, 40_000, seed=3), "day", ["id"])


def test_erf_inv(spark):
    assert erf_inv(0.95) * math.sqrt(2) == pytest.approx(1.959963984540054, abs=1e-12)
    assert erf_inv(1) == math.inf and erf_inv(-1) == -math.inf and math.isnan(erf_inv(1.5))
    xs = [-0.999, -0.5, 0.0, 0.3, 0.95, 0.9999]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(erf_inv_column(F.col("x")), erf_column(F.col("x") * 5), "x").collect()
    for y, e, x in got:
        assert y == pytest.approx(erf_inv(x), abs=1e-5)
        assert e == pytest.approx(math.erf(5 * x), abs=1e-12)


def test_rejected_draws_count_as_zeros(spark):
    values, rejected = [3.0, 5.0, 9.0], 4
    mean = sum(values) / 3
    ss = sum((v - mean) ** 2 for v in values)
    every = values + [0.0] * rejected
    m = sum(every) / 7
    expected = erf_inv(0.9) * math.sqrt(2 * sum((v - m) ** 2 for v in every) / (7 * 6))
    one = spark.range(1)
    got = one.select(clt_half_width(F.lit(3), F.lit(17.0), F.lit(ss), F.lit(7), 0.9), clt_half_width(F.lit(1), F.lit(2.0), F.lit(0.0), F.lit(1), 0.9), clt_half_width(F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(5), 0.9)).first()
    assert got[0] == pytest.approx(expected, rel=1e-12) and got[1] is None and got[2] == 0.0


def test_rank_index_is_dense(spark, index):
    r = index.rows.agg(F.min("rank"), F.max("rank"), F.count_distinct("rank"), F.count("*")).first()
    assert tuple(r) == (0, index.weight - 1, index.weight, index.weight)
    stats = index.key_stats()
    assert stats.agg(F.sum("cnt")).first()[0] == index.weight
    assert stats.where("hi_rank - lo_rank <> cnt").isEmpty()
    some = tables.lineitem(spark, SF).where("shipdate_julian >= 2450084 and shipdate_julian < 2450814").count()
    assert index.range_weight((2450084, 2450814)) == some
    assert index.range_weight((1, 2)) == 0


def test_null_keys_have_no_rank(spark):
    df = spark.createDataFrame([(None, 1), (5, 2), (5, 3), (7, 4)], "k int, id int")
    idx = build_rank_index(df, "k", ["id"])
    assert idx.weight == 3 and sorted(r["rank"] for r in idx.rows.collect()) == [0, 1, 2]
    assert build_rank_index(df.limit(0), "k", ["id"]).weight == 0
    with pytest.raises(ValueError):
        build_rank_index(df.withColumn("a", F.array("id")), "a", ["id"])


def test_swr_contract(index):
    assert swr(index, 0, 1).count() == 0 and swr(index, 10, 1, (1, 2)).count() == 0
    with pytest.raises(ValueError):
        swr(index, -1)
    with pytest.raises(ValueError):
        swr(index, None)
    a, b, c = (sorted(map(tuple, swr(index, 50, s).select("__draw", "rank").collect())) for s in (4, 4, 5))
    assert a == b != c and len(a) == 50


def test_coverage_of_intervals(spark, index):
    """Two hundred seeds, as strata of one job: unbiased, and covered about as often as promised."""
    n, runs = 300, 200
    pred = F.col("l_quantity") < 30
    truth = index.rows.where(pred).agg(F.sum("l_extendedprice")).first()[0]
    strata = [Stratum(k, 0, index.weight, n) for k in range(runs)]
    rows = stratum_stats(swr_strata(index, strata, 9, pred), {"y": approx_sum(F.col("l_extendedprice"))}).collect()
    means = [r.y__s / n for r in rows]
    halves = [1.96 * math.sqrt(max(0, r.y__ss - r.y__s**2 / n) / (n * (n - 1))) for r in rows]
    spread = math.sqrt(sum((m - truth) ** 2 for m in means)) / runs
    assert abs(sum(means) / runs - truth) < 4 * spread
    assert 0.90 <= sum(abs(m - truth) <= h for m, h in zip(means, halves, strict=True)) / runs <= 0.985


def test_edge_draws(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, -4.0), (2, 3, 6.0)], "k int, id int, v double")
    idx = build_rank_index(df, "k", ["id"])
    aggs = {"s": approx_sum(F.col("v")), "c": approx_count(F.col("v")), "n": approx_count()}
    all_rejected = estimate(swr(idx, 20, 1, None, F.lit(False)), [Stratum(0, 0, 3, 20)], aggs).first()
    assert all_rejected["n"] == 0 and all_rejected["n_half_ci"] == 0
    single = estimate(swr(idx, 1, 1), [Stratum(0, 0, 3, 1)], aggs).first()
    assert single["n"] == 3 and single["n_half_ci"] is None
    empty = OnlineAggregator(idx).run(aggs, 100, 10, abs_error=1.0, ranges={"k": (8, 9)})
    assert empty.value("s") == (0.0, None) and empty.draws == 0
    one = build_rank_index(df.where("id = 3"), "k", ["id"])
    got = estimate(swr(one, 5, 2), [Stratum(0, 0, 1, 5)], aggs).first()
    assert got["s"] == 6.0 and got["s_half_ci"] == 0.0


def test_high_rejection_warns():
    with pytest.warns(UserWarning):
        assert samplers.warn_rejections(0, 5000)
    assert not samplers.warn_rejections(10, 5000)


def test_combine_phases():
    mean, var, n = combine_phases([(10.0, 4.0, 100), (20.0, 1.0, 300)])
    assert (mean, n) == (17.5, 400) and var == pytest.approx(4 / 16 + 9 / 16)
    assert combine_phases([]) == (0.0, 0.0, 0)


def test_random_match_is_unbiased(spark):
    left = spark.createDataFrame([(k, k % 3) for k in range(60)], "id int, g int")
    fan = {0: 0, 1: 1, 2: 50}
    right = spark.createDataFrame([(g, j, float(j)) for g, n in fan.items() for j in range(n)], "rg int, j int, x double")
    idx, matched = build_rank_index(left, "id", []), build_rank_index(right, "rg", ["j"])
    n = 4000
    sample = matches.random_match(swr(idx, n, 5), "g", matched, 5)
    got = estimate(sample, [Stratum(0, 0, 60, n)], {"n": Agg("count_star"), "x": Agg("sum", F.col("x"))}, 0.95).first()
    assert sample.count() == n
    assert abs(got["n"] - 20 * 51) < 2 * got["n_half_ci"] and abs(got["x"] - 20 * sum(range(50))) < 2 * got["x_half_ci"]


def test_allocation_invariants():
    conf = AqpConf()
    stats = allocate.PrefixStats.from_cells(list(range(0, 1001, 10)), [10.0] * 100, [0.0] * 40 + [90.0] * 10 + [0.0] * 50, [0.0] * 40 + [1000.0] * 10 + [0.0] * 50)
    for name in ("uniform", "equal", "size", "cost", "greedy", "greedy_dp"):
        strata = allocate.allocate(name, stats, 2000, conf)
        assert strata[0].lo == 0 and strata[-1].hi == 1000
        assert all(a.hi == b.lo for a, b in zip(strata, strata[1:], strict=False))
        assert sum(s.draws for s in strata) == 2000 and min(s.draws for s in strata) >= 2
        capped = allocate.cap(strata, 500)
        assert sum(s.draws for s in capped) == 500
    best = allocate.best_bounds(stats, 3)
    assert {40, 50} <= set(best)
    assert allocate.cut_points(5, 5, 10) == [5] and allocate.cut_points(0, 3, 10) == [0, 1, 2, 3]


def test_strategies_on_clustered_data(spark, skewed):
    """Where the interesting rows are clustered, informed strata beat one stratum of as many draws."""
    late = F.col("late")
    truth = skewed.rows.where(late).agg(F.sum("amount")).first()[0]
    width = {}
    for name, settings in {"uniform": {"dp_intervals_count": 1}, "size": {"optimization_strategy": 2}, "cost": {}, "greedy": {"batch_sampling": True}, "dp": {"batch_sampling": True, "batch_sampling_dp": True}}.items():
        conf = AqpConf(progressive_round_size=6000, **settings)
        r = OnlineAggregator(skewed, conf).run({"y": approx_sum(F.col("amount"))}, 12_000, 3000, abs_error=1e-3, predicate=late, seed=2)
        est, width[name] = r.value()
        assert r.draws <= 12_000 and abs(est - truth) < 3 * width[name], name
        assert "Sampling: PSWR" in r.explain()
    assert all(width[k] < 0.9 * width["uniform"] for k in ("size", "cost", "greedy", "dp"))


def test_online_stops_and_falls_back(skewed):
    late = F.col("late")
    aggs = {"n": approx_count(), "s": approx_sum(F.col("amount"))}
    r = OnlineAggregator(skewed).run(aggs, 50_000, 1000, rel_error=0.2, predicate=late)
    assert r.met and r.draws < 50_000 and r.value("n")[1] <= 0.2 * r.value("n")[0]
    again = OnlineAggregator(skewed).run(aggs, 50_000, 1000, rel_error=0.2, predicate=late)
    assert again.values == r.values
    fall = OnlineAggregator(skewed, AqpConf(enable_pswr_switch_to_uniform=True, progressive_round_size=500, optimization_strategy=2)).run(aggs, 4000, 300, abs_error=0.1, predicate=late)
    assert fall.draws <= 4000
    small = OnlineAggregator(skewed, AqpConf(pswr_to_swr=True)).run(aggs, 900, 100, abs_error=0.1, predicate=late)
    assert small.strategy == "uniform"
    one = OnlineAggregator(skewed).run(aggs, 900, 500, abs_error=0.1, predicate=late, all_equal=True)
    assert {r.phase for r in one.rounds} == {1} and one.strategy == "uniform" and not one.strata
    some = OnlineAggregator(skewed, AqpConf(optimization_strategy=2)).run({"s": aggs["s"]}, 900, 500, abs_error=0.0, ranges={"day": (3, 4)})
    assert {r.phase for r in some.rounds} == {1} and some.strategy == "uniform" and some.draws == 900
    grouped = OnlineAggregator(skewed).run(aggs, 3000, 1000, abs_error=1.0, by=["late"])
    assert sum(v["n"][0] for v in grouped.values.values()) == pytest.approx(skewed.weight, rel=1e-6)
    with pytest.raises(ValueError):
        OnlineAggregator(skewed).run(aggs, 10, 10)


def test_chooses_narrowest_index(spark):
    t = tables.lineitem(spark, SF)
    a, b = build_rank_index(t, "shipdate_julian", tables.LINEITEM_ID), build_rank_index(t, "l_partkey", tables.LINEITEM_ID)
    ranges = {"shipdate_julian": (2450084, 2451545), "l_partkey": (0, 5)}
    assert OnlineAggregator([a, b]).choose(ranges)[0] is b
    assert OnlineAggregator([a, b], AqpConf(pswr_chosen_plan_index=0)).choose(ranges)[0] is a


def test_conf(spark):
    with pytest.raises(ValueError):
        AqpConf(dp_intervals_count=0)
    with pytest.raises(ValueError):
        AqpConf().set(no_such=1)
    spark.conf.set("aqp.dp_intervals_count", "7")
    spark.conf.set("aqp.batch_sampling", "on")
    conf = AqpConf.from_session(spark)
    spark.conf.unset("aqp.dp_intervals_count")
    spark.conf.unset("aqp.batch_sampling")
    assert conf.dp_intervals_count == 7 and conf.strategy == "greedy" and AqpConf().default_sample == 1000


def test_block_and_system_samplers(spark, tmp_path, monkeypatch):
    df = tables.load(spark, SF, "orders")
    assert samplers.block_sample(10, 4, 1) == sorted(samplers.block_sample(10, 4, 1)) and len(samplers.block_sample(3, 9)) == 3
    assert samplers.system_rows(df, 10**6, ["o_orderkey"]).count() == df.count()
    assert samplers.bernoulli(df, 0, ["o_orderkey"]).count() == 0 and samplers.bernoulli(df, 100, ["o_orderkey"]).count() == df.count()
    for bad in (None, -1, 101):
        with pytest.raises(ValueError):
            samplers.bernoulli(df, bad, ["o_orderkey"])
    assert samplers.system_time(df, 0, ["o_orderkey"]).count() == 0
    df.repartition(12).write.parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many"))
    assert samplers.system_time(many, 60_000, ["o_orderkey"]).count() == df.count()
    clock = iter(range(1000))
    monkeypatch.setattr(samplers.time, "monotonic", lambda: next(clock) * 0.3)
    some = samplers.system_time(many, 1000, ["o_orderkey"], 3)
    monkeypatch.undo()
    assert 0 < some.count() < df.count() and some.columns == df.columns
    assert samplers.estimated_rows(0) == 1000 and samplers.estimated_rows(7) == 7


def test_generators(spark):
    for place in ("front", "back", "random"):
        ranges = high_variance_ranges(3, 500, placement=place, seed=1)
        assert all(a.first + a.days <= b.first for a, b in zip(ranges, ranges[1:], strict=False)) and ranges[-1].first + ranges[-1].days <= 500
    z = spark.range(20_000).select(zipf_int((F.col("id") + 0.5) / 20_000.0, 1000, 1.0).alias("z"))
    assert z.where("z = 1").count() > 5 * z.where("z between 500 and 510").count()
    assert z.agg(F.max("z")).first()[0] <= 1000


def test_ratio_and_notice(spark, index, caplog):
    sample, strata = swr(index, 3000, 3), [Stratum(0, 0, index.weight, 3000)]
    volume = F.expr("l_extendedprice * (1 - l_discount)")
    got = ratio(sample, strata, Agg("sum", F.when(F.col("l_returnflag") == "R", volume)), Agg("sum", volume)).first()
    truth = index.rows.agg(F.sum(F.when(F.col("l_returnflag") == "R", volume)) / F.sum(volume)).first()[0]
    assert abs(got["ratio"] - truth) < 2 * got["ratio_half_ci"] < 0.1
    with caplog.at_level("INFO"):
        OnlineAggregator(index, AqpConf(tablesample_swr_ask_for_samples_attempted=True)).run({"n": approx_count()}, 100, 50, rel_error=0.5)
    assert "N=50" in caplog.text
    assert running_sample_size(sample).agg(F.max("__running_n")).first()[0] == 3000
    assert sample.select(F.sum(sample_prob() * inv_sample_prob())).first()[0] == pytest.approx(3000)


def test_ranks_beyond_32_bits(spark):
    """Draws reach every rank of a range wider than 2^32, and are exact products."""
    import hashlib

    width = (1 << 52) + 12_345
    numbers = spark.range(3000).select(draws.u60(5, "wide", F.col("id")).alias("u"))
    rows = numbers.select("u", draws.below(F.col("u"), F.lit(width)).alias("at"), draws.below(F.col("u"), F.lit(7)).alias("few")).collect()
    assert [r.u for r in rows[:5]] == [int(hashlib.md5(f"5|wide|{i}".encode()).hexdigest()[:15], 16) for i in range(5)]
    assert all(r.at == r.u * width >> 60 and r.few == r.u * 7 >> 60 for r in rows)
    assert len({r.at for r in rows}) == 3000 and len({r.at % (1 << 20) for r in rows}) > 2900
    assert abs(sum(r.at for r in rows) / 3000 / width - 0.5) < 0.03
    top = spark.range(1).select(draws.below(F.lit((1 << 60) - 1), F.lit(1 << 60)).alias("x")).first().x
    assert top == (1 << 60) - 1


def test_large_samples_do_not_pass_one_task(spark, monkeypatch):
    df = spark.range(3000).withColumn("v", F.col("id") * 2)
    want = samplers.system_rows(df, 777, ["id"], 5).collect()
    monkeypatch.setattr(samplers, "TOP_ROWS", 10)
    monkeypatch.setattr(samplers, "SAMPLE_BITS", 6)
    assert sorted(samplers.system_rows(df, 777, ["id"], 5).collect()) == sorted(want)
    assert samplers.system_rows(df, 5000, ["id"], 5).count() == 3000


def test_indexes_follow_their_files(spark, tmp_path):
    from driftgauge.plans import tpch

    part = tables.load(spark, SF, "part").cache()
    part.write.parquet(str(tmp_path / "part.parquet"))
    assert tpch.index(spark, str(tmp_path), "part", "p_size").weight == part.count()
    part.limit(50).write.mode("overwrite").parquet(str(tmp_path / "part.parquet"))
    assert tpch.index(spark, str(tmp_path), "part", "p_size").weight == 50
