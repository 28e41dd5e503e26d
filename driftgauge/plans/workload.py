"""The single-table workloads and the sampling operators as registered queries.

Four shapes: a rare event by day, a threshold by day, a flag by a small integer
key, and a revenue sum by ship date, on the nearest columns of the given tables.
Samples depend on seeds alone, so that an independent database can draw them
again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge import tables
from driftgauge.conf import AqpConf
from driftgauge.operators import samplers
from driftgauge.operators.allocate import cut_points
from driftgauge.operators.estimators import Agg, estimate, subsample_estimate
from driftgauge.operators.rank_index import RankIndex, build_rank_index
from driftgauge.operators.samplers import Stratum, scan_stratified, swr, swr_strata
from driftgauge.plans import tpch
from driftgauge.plans.tpch import Z, below_sql, facts_oracle, u32_sql
from driftgauge.streaming.online import OnlineAggregator

SEED, DRAWS, STRATA, CONFIDENCE = 11, 3000, 10, 0.95
_J = "date_diff('day', DATE '1970-01-01', CAST({} AS DATE)) + 2440588"


@dataclass(frozen=True)
class Workload:
    table: str
    key: str
    tie: tuple[str, ...]
    low: int
    high: int
    residual: str
    measure: str  # "1" counts
    scan_rate: float


WORKLOADS = {
    "flight": Workload("events", "julian_date", ("event_id",), 2460315, 2460331, "event_type = 'error'", "1", 0.2),
    "intel": Workload("events", "julian_date", ("event_id",), 2460313, 2460335, "value > 27", "1", 0.2),
    "census": Workload("part", "p_size", ("p_partkey",), 10, 40, "p_type = 'PROMO'", "1", 0.4),
    "tpch": Workload("lineitem", "shipdate_julian", tables.LINEITEM_ID, 2450084, 2451545, "l_quantity < 24 AND l_discount >= 0.05", "l_extendedprice * (1 - l_discount)", 0.2),
}
#: Session settings of the strategies.
STRATEGIES = {
    "uniform": {"optimization_strategy": 1, "dp_intervals_count": 1},
    "equal": {"optimization_strategy": 3, "dp_intervals_count": 20},
    "sizeopt": {"optimization_strategy": 2},
    "costopt": {"optimization_strategy": 1, "pswr_tree": True},
    "greedy": {"batch_sampling": True, "subtree_sample_size": 600},
    "greedy_dp": {"batch_sampling": True, "batch_sampling_dp": True},
    "fallback": {"optimization_strategy": 2, "enable_pswr_switch_to_uniform": True},
}
_indexes: dict[tuple, RankIndex] = {}


def source(spark: SparkSession, sf_dir: str, w: Workload) -> DataFrame:
    return {"events": tables.events, "lineitem": tables.lineitem}.get(w.table, lambda s, d: tables.load(s, d, w.table))(spark, sf_dir)


def index(spark: SparkSession, sf_dir: str, w: Workload) -> RankIndex:
    if w.table in tpch.TIES:  # the suite's indexes are of the same tables
        return tpch.index(spark, sf_dir, w.table, w.key)
    at = (spark.sparkContext.applicationId, sf_dir, w.table, w.key, tables.version(spark, sf_dir, w.table))
    if at not in _indexes:
        _indexes[at] = build_rank_index(source(spark, sf_dir, w), w.key, w.tie)
    return _indexes[at]


def _agg(w: Workload) -> Agg:
    return Agg("count_star") if w.measure == "1" else Agg("sum", F.expr(w.measure))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 2).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _ranked_sql(w: Workload) -> str:
    extra = {"events": f"{_J.format('ts')} AS julian_date", "lineitem": f"{_J.format('l_shipdate')} AS shipdate_julian"}.get(w.table)
    src = f"(SELECT *, {extra} FROM {w.table})" if extra else w.table
    return f"SELECT *, row_number() OVER (ORDER BY {', '.join([w.key, *w.tie])}) - 1 AS rank FROM {src}"


def swr_query(w: Workload) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        idx = index(spark, sf_dir, w)
        sample = swr(idx, DRAWS, SEED, (w.low, w.high), F.expr(w.residual))
        return _rounded(estimate(sample, [Stratum(0, *idx.bounds((w.low, w.high)), DRAWS)], {"y": _agg(w)}, CONFIDENCE))

    return run


def strata_query(w: Workload) -> Callable[[SparkSession, str], DataFrame]:
    """Equal strata, the same number of draws in each."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        idx = index(spark, sf_dir, w)
        bounds = cut_points(*idx.bounds((w.low, w.high)), STRATA)
        strata = [Stratum(k, a, b, DRAWS // STRATA) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
        return _rounded(estimate(swr_strata(idx, strata, SEED, F.expr(w.residual)), strata, {"y": _agg(w)}, CONFIDENCE))

    return run


def strata_oracle(w: Workload, strata: int = STRATA) -> str:
    n = DRAWS // strata
    drawn = below_sql(f"'{SEED}|swr|' || CAST(k AS VARCHAR) || ':' || CAST(dr AS VARCHAR)", "w")
    x = f"CASE WHEN {w.residual} THEN CAST({w.measure} AS DOUBLE) * w ELSE 0 END"
    return f"""
WITH idx AS ({_ranked_sql(w)}),
b AS (SELECT min(rank) AS lo, count(*) AS n FROM idx WHERE {w.key} >= {w.low} AND {w.key} < {w.high}),
s AS (SELECT range AS k, lo + n * range // {strata} AS a, lo + n * (range + 1) // {strata} - (lo + n * range // {strata}) AS w FROM range({strata}), b),
d AS (SELECT k, w, a + {drawn} AS rank FROM s, (SELECT range AS dr FROM range({n}))),
x AS (SELECT k, {x} AS x FROM d JOIN idx USING (rank)),
t AS (SELECT k, sum(x) AS s, sum(x * x) AS ss FROM x GROUP BY k)
SELECT round(sum(s) / {n}, 2) AS y, round({Z} * sqrt(sum(greatest(ss - s * s / {n}, 0) / ({n}.0 * ({n} - 1)))), 2) AS y_half_ci FROM t"""


def key_stratified_query(w: Workload) -> Callable[[SparkSession, str], DataFrame]:
    """Scan sampling stratified by the index key."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        by = _ids(w)
        base = source(spark, sf_dir, w).select(*dict.fromkeys([w.key, *by, *_needed(w)]))
        sample = scan_stratified(base, [w.key], w.scan_rate, by, seed=SEED).where(f"{w.residual} AND {w.key} >= {w.low} AND {w.key} < {w.high}")
        out = subsample_estimate(sample, {"y": F.lit(1.0) if w.measure == "1" else F.expr(w.measure)})
        return out.select(F.round("y", 2).alias("y"), F.round("y_err", 2).alias("y_err"))

    return run


def _needed(w: Workload) -> list[str]:
    return {"events": ["event_type", "value"], "part": ["p_type"], "lineitem": ["l_quantity", "l_discount", "l_extendedprice"]}[w.table]


def _ids(w: Workload) -> list[str]:
    return ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"] if w.table == "lineitem" else list(w.tie)


def key_stratified_oracle(w: Workload) -> str:
    text = "concat_ws(':', " + ", ".join(f"CAST(t.{c} AS VARCHAR)" for c in _ids(w)) + ")"
    u = u32_sql(f"concat('{SEED}|scan|', {text})") + " / 4294967296.0"
    part = u32_sql(f"concat('{SEED}|part|', {text})") + " % 100"
    return f"""
WITH t AS ({_ranked_sql(w)}),
g AS (SELECT {w.key} AS gk, count(*) AS gsize FROM t GROUP BY 1),
k AS (SELECT t.*, gsize FROM t JOIN g ON {w.key} IS NOT DISTINCT FROM gk WHERE {u} < ((SELECT sum(gsize) FROM g) * {w.scan_rate} / (SELECT count(*) FROM g)) / gsize),
c AS (SELECT {w.key} AS ck, count(*) AS taken FROM k GROUP BY 1),
x AS (SELECT taken / CAST(gsize AS DOUBLE) AS vprob, {part} AS vpart, CAST({w.measure} AS DOUBLE) AS m FROM k t JOIN c ON {w.key} IS NOT DISTINCT FROM ck WHERE {w.residual} AND {w.key} >= {w.low} AND {w.key} < {w.high}),
p AS (SELECT sum(m / vprob) / count(*) * sum(count(*)) OVER () AS e, count(*) AS n FROM x GROUP BY vpart)
SELECT round(sum(e * n) / sum(n), 2) AS y, round(stddev_samp(e) * sqrt(avg(n)) / sqrt(sum(n)) * 1.96, 2) AS y_err FROM p"""


PSWR_BUDGET, PSWR_PILOT, PSWR_ERROR = 60_000, 2000, 0.05


def pswr_query(w: Workload, strategy: str) -> Callable[[SparkSession, str], DataFrame]:
    """Progressive sampling to a relative half-width of 5 %: the exact value, and whether the run kept its promises."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        conf = AqpConf(progressive_round_size=20_000, **STRATEGIES[strategy])
        agg = OnlineAggregator(index(spark, sf_dir, w), conf)
        found = agg.run({"y": _agg(w)}, PSWR_BUDGET, PSWR_PILOT, CONFIDENCE, rel_error=PSWR_ERROR, ranges={w.key: (w.low, w.high)}, predicate=F.expr(w.residual), seed=SEED)
        rows = source(spark, sf_dir, w).where(f"{w.residual} AND {w.key} >= {w.low} AND {w.key} < {w.high}")
        return found.facts(rows.select(F.round(F.coalesce(F.sum(F.expr(w.measure)), F.lit(0)).cast("double"), 2).alias("y")), PSWR_BUDGET, PSWR_ERROR)

    return run


def pswr_oracle(w: Workload) -> str:
    return facts_oracle(f"SELECT round(CAST(coalesce(sum({w.measure}), 0) AS DOUBLE), 2) AS y FROM ({_ranked_sql(w)}) WHERE {w.residual} AND {w.key} >= {w.low} AND {w.key} < {w.high}")


#: A run that no target ends: its pilot, and the draws of each round.
ROUNDS = (2000, 4000, 4000)


def rounds_query(w: Workload, strategy: str) -> Callable[[SparkSession, str], DataFrame]:
    """A pilot and two rounds of progressive sampling: the estimate, its half-width and the draws."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        conf = AqpConf(progressive_round_size=ROUNDS[1], **STRATEGIES[strategy])
        agg = OnlineAggregator(index(spark, sf_dir, w), conf)
        found = agg.run({"y": _agg(w)}, sum(ROUNDS), ROUNDS[0], CONFIDENCE, abs_error=0.0, ranges={w.key: (w.low, w.high)}, predicate=F.expr(w.residual), seed=SEED)
        return found.to_df(spark).select(F.round("y", 2).alias("y"), F.round("y_half_ci", 2).alias("y_half_ci"), "draws", "accepted")

    return run


def rounds_oracle(w: Workload, strata: int) -> str:
    """The same draws by phase and stratum, and the phases weighted by their draws."""
    drawn = below_sql(f"'{SEED}|' || tag || '|' || CAST(k AS VARCHAR) || ':' || CAST(dr AS VARCHAR)", "w")
    total = sum(ROUNDS)
    phases = ", ".join(f"('{'phase' + str(i + 1) if i else 'pilot'}', {n}, {strata if i else 1})" for i, n in enumerate(ROUNDS))
    return f"""
WITH idx AS ({_ranked_sql(w)}),
b AS (SELECT min(rank) AS lo, count(*) AS n FROM idx WHERE {w.key} >= {w.low} AND {w.key} < {w.high}),
s AS (SELECT tag, m, m // ks AS draws, range AS k, lo + n * range // ks AS a, lo + n * (range + 1) // ks - (lo + n * range // ks) AS w FROM (VALUES {phases}) p(tag, m, ks), b, range({strata}) WHERE range < ks),
d AS (SELECT tag, m, draws, k, w, a + {drawn} AS rank FROM s, (SELECT range AS dr FROM range({max(ROUNDS)})) WHERE dr < draws),
x AS (SELECT tag, m, draws, k, CASE WHEN {w.residual} THEN 1 ELSE 0 END AS hit, CASE WHEN {w.residual} THEN CAST({w.measure} AS DOUBLE) * w ELSE 0 END AS x FROM d JOIN idx USING (rank)),
t AS (SELECT tag, m, draws, k, sum(x) AS s, sum(x * x) AS ss, sum(hit) AS hits FROM x GROUP BY ALL),
p AS (SELECT m, sum(s / draws) AS mean, sum(greatest(ss - s * s / draws, 0) / (draws * (draws - 1.0))) AS var, sum(hits) AS hits FROM t GROUP BY tag, m)
SELECT round(sum(mean * m) / {total}, 2) AS y, round({Z} * sqrt(sum(var * (m / {total}.0) * (m / {total}.0))), 2) AS y_half_ci, {total} AS draws, sum(hits) AS accepted FROM p"""


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = WORKLOADS["tpch"]
    idx = index(spark, sf_dir, w)
    sample = swr(idx, DRAWS, SEED, (w.low, w.high), F.expr("l_quantity < 40"))
    aggs = {"rows": Agg("count_star"), "qty": Agg("sum", F.col("l_quantity")), "flags": Agg("count", F.expr("nullif(l_linestatus, 'F')"))}
    return _rounded(estimate(sample, [Stratum(0, *idx.bounds((w.low, w.high)), DRAWS)], aggs, CONFIDENCE, ["l_returnflag"]))


def _grouped_oracle() -> str:
    w, n = WORKLOADS["tpch"], DRAWS
    drawn = below_sql(f"'{SEED}|swr|0:' || CAST(range AS VARCHAR)", "w")
    cols = {"rows": "1", "qty": "l_quantity", "flags": "CASE WHEN l_linestatus <> 'F' THEN 1 ELSE 0 END"}
    outs = ", ".join(f"round(sum({c} * p) / {n}, 2) AS {k}, round({Z} * sqrt((sum({c} * p * {c} * p) - sum({c} * p) * sum({c} * p) / {n}) / ({n}.0 * ({n} - 1))), 2) AS {k}_half_ci" for k, c in cols.items())
    return f"""
WITH idx AS ({_ranked_sql(w)}),
b AS (SELECT min(rank) AS lo, count(*) AS w FROM idx WHERE {w.key} >= {w.low} AND {w.key} < {w.high}),
d AS (SELECT CAST(w AS DOUBLE) AS p, lo + {drawn} AS rank FROM range({n}), b)
SELECT l_returnflag, {outs} FROM d JOIN idx USING (rank) WHERE l_quantity < 40 GROUP BY l_returnflag"""


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir, WORKLOADS["census"]).key_stats()


def _range_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(k, index(spark, sf_dir, w).range_weight((w.low, w.high))) for k, w in WORKLOADS.items()]
    return spark.createDataFrame(rows, "workload string, weight long")


def _draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = WORKLOADS["census"]
    return swr(index(spark, sf_dir, w), 500, SEED, (w.low, w.high), F.expr(w.residual)).select("__draw", "rank", "p_partkey", "__inv_prob", "__accepted").withColumnsRenamed({"__draw": "draw", "__inv_prob": "inv_prob", "__accepted": "accepted"})


def _draws_oracle() -> str:
    w = WORKLOADS["census"]
    drawn = below_sql(f"'{SEED}|swr|0:' || CAST(range AS VARCHAR)", "w")
    return f"""
WITH idx AS ({_ranked_sql(w)}),
b AS (SELECT min(rank) AS lo, count(*) AS w FROM idx WHERE {w.key} >= {w.low} AND {w.key} < {w.high}),
d AS (SELECT range AS draw, CAST(w AS DOUBLE) AS inv_prob, lo + {drawn} AS rank FROM range(500), b)
SELECT draw, rank, p_partkey, inv_prob, {w.residual} AS accepted FROM d JOIN idx USING (rank)"""


def _simple(fn, *args, by: list[str], table: str, cols: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(tables.load(spark, sf_dir, table), *args, by, SEED).select(*cols)


def _text(*cols: str) -> str:
    return "concat_ws(':', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + ")"


def _number(tag: str, text: str) -> str:
    return u32_sql(f"concat('{SEED}|{tag}|', {text})")


SAMPLERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "swr_draws": (_draws, _draws_oracle()),
    "key_stats": (_weights, "SELECT p_size AS key, count(*) AS cnt, CAST(sum(count(*)) OVER (ORDER BY p_size) - count(*) AS BIGINT) AS lo_rank, CAST(sum(count(*)) OVER (ORDER BY p_size) AS BIGINT) AS hi_rank FROM part GROUP BY p_size"),
    "range_weight": (_range_weight, " UNION ALL ".join(f"SELECT '{k}' AS workload, count(*) AS weight FROM ({_ranked_sql(w)}) WHERE {w.key} >= {w.low} AND {w.key} < {w.high}" for k, w in WORKLOADS.items())),
    "grouped_estimate": (_grouped, _grouped_oracle()),
    "bernoulli": (_simple(samplers.bernoulli, 10.0, by=["o_orderkey"], table="orders", cols=["o_orderkey", "o_totalprice"]), f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_number('bernoulli', _text('o_orderkey'))} < 429496730"),
    "system": (_simple(samplers.system, 20.0, by=["o_orderkey"], table="orders", cols=["o_orderkey"]), f"SELECT o_orderkey FROM orders WHERE {_number('system', 'CAST(' + u32_sql(f'''concat('block|', {_text('o_orderkey')})''') + ' % 1024 AS VARCHAR)')} < 858993459"),
    "system_rows": (_simple(samplers.system_rows, 250, by=["c_custkey"], table="customer", cols=["c_custkey"]), f"SELECT c_custkey FROM customer ORDER BY {_number('rows', _text('c_custkey'))}, c_custkey LIMIT 250"),
    "reservoir": (_simple(samplers.reservoir, 40, by=["s_suppkey"], table="supplier", cols=["s_suppkey", "s_acctbal"]), f"SELECT s_suppkey, s_acctbal FROM supplier ORDER BY {_number('rows', _text('s_suppkey'))}, s_suppkey LIMIT 40"),
    "system_time": (lambda spark, sf_dir: samplers.system_time(tables.load(spark, sf_dir, "customer"), 1500.0, ["c_custkey"], SEED), ""),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f"sample_{k}": fn for k, (fn, _) in SAMPLERS.items()}
    for k, w in WORKLOADS.items():
        found |= {f"{k}_swr": swr_query(w), f"{k}_strata": strata_query(w), f"{k}_key_stratified": key_stratified_query(w)}
        found |= {f"{k}_pswr_{s}": pswr_query(w, s) for s in STRATEGIES}
        found |= {f"{k}_rounds_{s}": rounds_query(w, s) for s in ("uniform", "equal")}
    return found


def oracle_sql() -> dict[str, str]:
    found = {f"sample_{k}": sql for k, (_, sql) in SAMPLERS.items() if sql}
    for k, w in WORKLOADS.items():
        found |= {f"{k}_swr": strata_oracle(w, 1), f"{k}_strata": strata_oracle(w), f"{k}_key_stratified": key_stratified_oracle(w)}
        found |= {f"{k}_pswr_{s}": pswr_oracle(w) for s in STRATEGIES}
        found |= {f"{k}_rounds_uniform": rounds_oracle(w, 1), f"{k}_rounds_equal": rounds_oracle(w, STRATEGIES["equal"]["dp_intervals_count"])}
    return found
