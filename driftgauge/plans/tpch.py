"""The decision-support suite: 22 queries in exact and sampled forms.

Each query is a :class:`Spec`: a body in SQL that both the engine and an
independent database run, its measures, the universe key and the sampled walk.
The given tables lack some columns of the original schema; the bodies use the
nearest columns there are, and ``partsupp`` is made of the (part, supplier)
pairs of lineitem.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge import tables
from driftgauge.conf import AqpConf
from driftgauge.operators import matches
from driftgauge.operators.estimators import Agg, estimate, subsample_estimate
from driftgauge.operators.rank_index import RankIndex, build_rank_index
from driftgauge.operators.samplers import Stratum, scan_stratified, scan_uniform, swr, universe
from driftgauge.streaming.online import AqpResult, OnlineAggregator

#: Draws, seed and confidence of the registered walks; rates of the registered scans.
DRAWS, SEED, CONFIDENCE = 4000, 7, 0.95
UNIVERSE_RATE, SCAN_RATE = 0.3, 0.2
#: The suite's progressive form is pswr(30000000, 100000, 0.05, 0.95); a round has so many draws at most.
PSWR_BUDGET, PSWR_PILOT, PSWR_ERROR, PSWR_ROUND = 30_000_000, 100_000, 0.05, 1_000_000
Z = "1.959963984540054"

PARTSUPP = """
SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, count(*) * 1000 AS ps_availqty, min(l_extendedprice / l_quantity) * 0.1 AS ps_supplycost
FROM lineitem GROUP BY l_partkey, l_suppkey"""
REVENUE = "l_extendedprice * (1 - l_discount)"


@dataclass(frozen=True)
class Join:
    """A step of the walk: ``left`` of the rows so far equals ``right`` of the table; ``many`` draws one of several matches."""

    table: str
    left: str
    right: str
    many: bool = False
    alias: str = ""


@dataclass(frozen=True)
class Spec:
    sources: str
    where: str
    measures: dict[str, str]  # name -> sum of this; "1" counts
    driver: str
    key: str
    key_range: tuple[int | None, int | None]
    walk: tuple[Join, ...] = ()
    walk_where: str = "true"
    universe: dict[str, str] = field(default_factory=dict)  # table -> key
    exact: str = ""  # the exact select list if it is more than the measures

    def body(self) -> str:
        return f"FROM {self.sources} WHERE {self.where}"


def _julian(year: int, month: int, day: int = 1) -> int:
    from datetime import date

    return (date(year, month, day) - date(1970, 1, 1)).days + tables.JULIAN_EPOCH


_ORDERS = Join("orders", "l_orderkey", "o_orderkey")
_CUSTOMER = Join("customer", "o_custkey", "c_custkey")
_SUPPLIER = Join("supplier", "l_suppkey", "s_suppkey")
_PART = Join("part", "l_partkey", "p_partkey")
_S_NATION = Join("nation", "s_nationkey", "n_nationkey")
_LO = {"lineitem": "l_orderkey", "orders": "o_orderkey"}
_ALL = (None, None)


def _nation(left: str, alias: str) -> Join:
    return Join("nation", left, f"{alias}_nationkey", alias=alias)


SPECS: dict[str, Spec] = {
    "q1": Spec("lineitem", "l_shipdate <= date '1998-12-01' - interval '90' day AND l_returnflag = 'A' AND l_linestatus = 'F'",
               {"sum_qty": "l_quantity", "sum_base_price": "l_extendedprice", "sum_disc_price": REVENUE, "sum_charge": f"{REVENUE} * (1 + l_tax)", "count_order": "1"},
               "lineitem", "shipdate_julian", (None, _julian(1998, 9, 3)), (), "l_returnflag = 'A' AND l_linestatus = 'F'"),
    "q2": Spec("part, supplier, partsupp, nation, region", "p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_type LIKE '%ARD' AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'",
               {"matching_supplier_part_count": "1"}, "part", "p_size", _ALL,
               (Join("partsupp", "p_partkey", "ps_partkey", True), Join("supplier", "ps_suppkey", "s_suppkey"), _S_NATION, Join("region", "n_regionkey", "r_regionkey")),
               "p_type LIKE '%ARD' AND r_name = 'EUROPE'", {"partsupp": "ps_partkey", "part": "p_partkey"}),
    "q3": Spec("customer, orders, lineitem", "c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < date '1998-03-15' AND l_shipdate > date '1998-03-15'",
               {"revenue": REVENUE}, "lineitem", "shipdate_julian", (_julian(1998, 3, 16), None), (_ORDERS, _CUSTOMER), "c_mktsegment = 'BUILDING' AND o_orderdate < date '1998-03-15'", _LO),
    "q4": Spec("orders, lineitem", "o_orderkey = l_orderkey AND o_orderdate >= date '1996-07-01' AND o_orderdate < date '1996-10-01' AND l_shipdate > o_orderdate + interval '30' day AND o_orderpriority = '1-URGENT'",
               {"order_count": "1"}, "lineitem", "shipdate_julian", (_julian(1996, 7), None), (_ORDERS,),
               "o_orderdate >= date '1996-07-01' AND o_orderdate < date '1996-10-01' AND l_shipdate > o_orderdate + interval '30' day AND o_orderpriority = '1-URGENT'", _LO),
    "q5": Spec("customer, orders, lineitem, supplier, nation, region", "c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= date '1996-01-01' AND o_orderdate < date '1998-01-01'",
               {"revenue": REVENUE}, "lineitem", "shipdate_julian", _ALL, (_ORDERS, _CUSTOMER, _SUPPLIER, _S_NATION, Join("region", "n_regionkey", "r_regionkey")),
               "c_nationkey = s_nationkey AND r_name = 'ASIA' AND o_orderdate >= date '1996-01-01' AND o_orderdate < date '1998-01-01'", _LO),
    "q6": Spec("lineitem", "l_shipdate >= date '1996-01-01' AND l_shipdate < date '1999-01-01' AND l_discount >= 0.07 AND l_discount <= 0.09 AND l_quantity < 24",
               {"revenue": "l_extendedprice * l_discount"}, "lineitem", "shipdate_julian", (_julian(1996, 1), _julian(1999, 1)), (), "l_discount >= 0.07 AND l_discount <= 0.09 AND l_quantity < 24"),
    "q7": Spec("supplier, lineitem, orders, customer, nation n1, nation n2", "s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND ((n1.n_name = 'NATION_3' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_3')) AND l_shipdate >= date '1996-01-01' AND l_shipdate < date '2000-01-01'",
               {"revenue": REVENUE}, "lineitem", "shipdate_julian", (_julian(1996, 1), _julian(2000, 1)), (_ORDERS, _CUSTOMER, _SUPPLIER, _nation("s_nationkey", "n1"), _nation("c_nationkey", "n2")),
               "(n1_name = 'NATION_3' AND n2_name = 'NATION_7') OR (n1_name = 'NATION_7' AND n2_name = 'NATION_3')", _LO),
    "q8": Spec("part, supplier, lineitem, orders, customer, nation n1, nation n2, region", "p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND r_name = 'EUROPE' AND s_nationkey = n2.n_nationkey AND o_orderdate >= date '1996-01-01' AND o_orderdate < date '1999-01-01' AND p_type = 'ECONOMY'",
               {"nation_volume": f"case when n2.n_name = 'NATION_3' then {REVENUE} else 0 end", "total_volume": REVENUE}, "lineitem", "shipdate_julian", _ALL,
               (_PART, _SUPPLIER, _ORDERS, _CUSTOMER, _nation("c_nationkey", "n1"), _nation("s_nationkey", "n2"), Join("region", "n1_regionkey", "r_regionkey")),
               "r_name = 'EUROPE' AND o_orderdate >= date '1996-01-01' AND o_orderdate < date '1999-01-01' AND p_type = 'ECONOMY'", _LO,
               f"round(sum(case when n2.n_name = 'NATION_3' then {REVENUE} else 0 end) / sum({REVENUE}), 6) AS mkt_share"),
    "q9": Spec("part, supplier, lineitem, partsupp, orders, nation", "s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%blue%' AND o_orderdate >= date '1996-01-01' AND o_orderdate <= date '1998-12-31'",
               {"sum_profit": f"{REVENUE} - ps_supplycost * l_quantity"}, "lineitem", "shipdate_julian", _ALL,
               (_ORDERS, _SUPPLIER, Join("partsupp", "l_partkey,l_suppkey", "ps_partkey,ps_suppkey"), _PART, _S_NATION), "p_name LIKE '%blue%' AND o_orderdate >= date '1996-01-01' AND o_orderdate <= date '1998-12-31'", _LO),
    "q10": Spec("customer, orders, lineitem, nation", "c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= date '1996-01-01' AND o_orderdate < date '1996-04-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey",
               {"revenue": REVENUE}, "lineitem", "shipdate_julian", _ALL, (_ORDERS, _CUSTOMER, Join("nation", "c_nationkey", "n_nationkey")),
               "o_orderdate >= date '1996-01-01' AND o_orderdate < date '1996-04-01' AND l_returnflag = 'R'", _LO),
    "q11": Spec("partsupp, supplier, nation", "ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7'",
               {"value": "ps_supplycost * ps_availqty"}, "partsupp", "ps_suppkey", _ALL, (Join("supplier", "ps_suppkey", "s_suppkey"), _S_NATION), "n_name = 'NATION_7'", {"partsupp": "ps_suppkey", "supplier": "s_suppkey"}),
    "q12": Spec("orders, lineitem", "o_orderkey = l_orderkey AND l_linenumber = 1 AND l_shipdate >= date '1997-01-01' AND l_shipdate < date '1998-01-01'",
               {"high_line_count": "case when o_orderpriority < '3' then 1 else 0 end", "low_line_count": "case when o_orderpriority >= '3' then 1 else 0 end"}, "lineitem", "shipdate_julian", (_julian(1997, 1), _julian(1998, 1)), (_ORDERS,), "l_linenumber = 1", _LO),
    "q13": Spec("customer, orders", "c_custkey = o_custkey AND o_orderpriority NOT LIKE '5%'",
               {"matching_order_count": "1"}, "orders", "o_custkey", _ALL, (_CUSTOMER,), "o_orderpriority NOT LIKE '5%'", {"orders": "o_custkey", "customer": "c_custkey"}),
    "q14": Spec("lineitem, part", "l_partkey = p_partkey AND l_shipdate >= date '1996-09-01' AND l_shipdate < date '1996-10-01'",
               {"promo_volume": f"case when p_type like 'PROMO%' then {REVENUE} else 0 end", "total_volume": REVENUE}, "lineitem", "shipdate_julian", (_julian(1996, 9), _julian(1996, 10)), (_PART,), "true", {"lineitem": "l_partkey", "part": "p_partkey"},
               f"round(100.00 * sum(case when p_type like 'PROMO%' then {REVENUE} else 0 end) / sum({REVENUE}), 6) AS promo_revenue"),
    "q15": Spec("supplier, lineitem", "s_suppkey = l_suppkey AND l_shipdate >= date '1996-01-01' AND l_shipdate < date '1998-04-01'",
               {"total_revenue": REVENUE}, "lineitem", "shipdate_julian", (_julian(1996, 1), _julian(1998, 4)), (_SUPPLIER,), "true", {"lineitem": "l_suppkey", "supplier": "s_suppkey"}),
    "q16": Spec("partsupp, part, supplier", "p_partkey = ps_partkey AND ps_suppkey = s_suppkey AND p_brand <> 'Brand#12' AND p_type NOT LIKE 'SMALL%' AND p_brand = 'Brand#23' AND p_size >= 10 AND p_size < 30 AND s_acctbal > 0",
               {"supplier_cnt": "1"}, "part", "p_size", (10, 30), (Join("partsupp", "p_partkey", "ps_partkey", True), Join("supplier", "ps_suppkey", "s_suppkey")),
               "p_brand <> 'Brand#12' AND p_type NOT LIKE 'SMALL%' AND p_brand = 'Brand#23' AND s_acctbal > 0", {"partsupp": "ps_suppkey", "supplier": "s_suppkey"}),
    "q17": Spec("lineitem, part", "p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity >= 10 AND l_quantity < 20",
               {"avg_yearly": "l_extendedprice / 7.0"}, "part", "p_size", _ALL, (Join("lineitem", "p_partkey", "l_partkey", True),), "p_brand = 'Brand#23' AND l_quantity >= 10 AND l_quantity < 20", {"lineitem": "l_partkey", "part": "p_partkey"}),
    "q18": Spec("customer, orders, lineitem", "c_custkey = o_custkey AND o_orderkey = l_orderkey AND l_quantity > 10",
               {"total_quantity": "l_quantity"}, "lineitem", "shipdate_julian", _ALL, (_ORDERS, _CUSTOMER), "l_quantity > 10", _LO),
    "q19": Spec("lineitem, part", "p_partkey = l_partkey AND p_brand = 'Brand#23' AND ((p_type = 'SMALL' AND l_quantity >= 1 AND l_quantity <= 11) OR (p_type = 'MEDIUM' AND l_quantity >= 10 AND l_quantity <= 20) OR (p_type = 'LARGE' AND l_quantity >= 20 AND l_quantity <= 30)) AND p_size >= 1 AND p_size <= 35",
               {"revenue": REVENUE}, "part", "p_size", (1, 36), (Join("lineitem", "p_partkey", "l_partkey", True),),
               "p_brand = 'Brand#23' AND ((p_type = 'SMALL' AND l_quantity >= 1 AND l_quantity <= 11) OR (p_type = 'MEDIUM' AND l_quantity >= 10 AND l_quantity <= 20) OR (p_type = 'LARGE' AND l_quantity >= 20 AND l_quantity <= 30))", {"lineitem": "l_partkey", "part": "p_partkey"}),
    "q20": Spec("supplier, nation, partsupp, part, lineitem", "s_nationkey = n_nationkey AND s_suppkey = ps_suppkey AND ps_partkey = p_partkey AND l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND p_name LIKE 'blue%' AND l_shipdate >= date '1996-01-01' AND l_shipdate < date '2000-01-01' AND ps_availqty > 0 AND s_acctbal > 0",
               {"cnt": "1"}, "lineitem", "shipdate_julian", (_julian(1996, 1), _julian(2000, 1)), (Join("partsupp", "l_partkey,l_suppkey", "ps_partkey,ps_suppkey"), _SUPPLIER, _S_NATION, _PART),
               "p_name LIKE 'blue%' AND ps_availqty > 0 AND s_acctbal > 0", {"lineitem": "concat(cast(l_partkey as varchar(20)), ':', cast(l_suppkey as varchar(20)))", "partsupp": "concat(cast(ps_partkey as varchar(20)), ':', cast(ps_suppkey as varchar(20)))"}),
    "q21": Spec("supplier, lineitem, orders, nation", "s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND o_orderstatus = 'F' AND l_linestatus = 'O' AND s_nationkey = n_nationkey AND n_name = 'NATION_7'",
               {"numwait": "1"}, "lineitem", "shipdate_julian", _ALL, (_SUPPLIER, _ORDERS, _S_NATION), "o_orderstatus = 'F' AND l_linestatus = 'O' AND n_name = 'NATION_7'", _LO),
    "q22": Spec("customer", "c_nationkey = 13 AND c_acctbal > 0", {"numcust": "1", "totacctbal": "c_acctbal"}, "customer", "c_custkey", _ALL, (), "c_nationkey = 13 AND c_acctbal > 0"),
}
#: Identifying columns of the driver tables.
TIES = {"lineitem": tables.LINEITEM_ID, "part": ("p_partkey",), "partsupp": ("ps_partkey", "ps_suppkey"), "orders": ("o_orderkey",), "customer": ("c_custkey",)}
_indexes: dict[tuple, RankIndex] = {}


def register(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Views of the tables that a query's text names."""
    made = "partsupp" in text
    tables.register_views(spark, sf_dir, text + (" lineitem" if made else ""))
    if made:
        spark.sql(PARTSUPP).createOrReplaceTempView("partsupp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "lineitem":
        return tables.lineitem(spark, sf_dir)
    if name == "partsupp":
        tables.load(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
        return spark.sql(PARTSUPP)
    return tables.load(spark, sf_dir, name)


def index(spark: SparkSession, sf_dir: str, name: str, key: str) -> RankIndex:
    """The table's index on the key, built once for a session and state of the files."""
    at = (spark.sparkContext.applicationId, sf_dir, name, key, tables.version(spark, sf_dir, "lineitem" if name == "partsupp" else name))
    if at not in _indexes:
        _indexes[at] = build_rank_index(table(spark, sf_dir, name), key, TIES[name])
    return _indexes[at]


def _select(measures: dict[str, str]) -> str:
    return ", ".join("count(*) AS " + n if m == "1" else f"round(cast(sum({m}) as double), 2) AS {n}" for n, m in measures.items())


def exact_sql(q: str) -> str:
    s = SPECS[q]
    return f"SELECT {s.exact or _select(s.measures)} {s.body()}"


def exact(q: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, exact_sql(q))
        return spark.sql(exact_sql(q))

    return run


def exact_oracle(q: str) -> str:
    sql = exact_sql(q)
    return f"WITH partsupp AS ({PARTSUPP}) {sql}" if "partsupp" in SPECS[q].sources else sql


def walk_sample(spark: SparkSession, sf_dir: str, q: str, n: int, seed: int) -> tuple[DataFrame, list[Stratum]]:
    """n draws of the driver, each joined with one match of every further table."""
    s = SPECS[q]
    idx = index(spark, sf_dir, s.driver, s.key)
    return walked(spark, sf_dir, q, swr(idx, n, seed, s.key_range), n, seed), [Stratum(0, *idx.bounds(s.key_range), n)]


def walked(spark: SparkSession, sf_dir: str, q: str, sample: DataFrame, n: int, seed: int, tag: str = "") -> DataFrame:
    """At most n draws of the driver, each joined with one match of every further table; ``tag`` tells phases apart."""
    s = SPECS[q]
    for k, j in enumerate(s.walk):
        if j.many:
            sample = matches.random_match(sample, j.left, index(spark, sf_dir, j.table, j.right), seed, f"{tag}match{k}", draws=n)
        else:
            right = table(spark, sf_dir, j.table)
            if j.alias:
                right = right.select(*[F.col(c).alias(c.replace("n_", f"{j.alias}_", 1)) for c in right.columns])
            sample = matches.lookup(sample, right, list(zip(j.left.split(","), j.right.split(","), strict=True)), draws=n)
    return matches.accept(sample, F.expr(s.walk_where))


def _walk_measure(m: str) -> str:
    return m.replace("n2.n_name", "n2_name")


def walk(q: str, n: int = DRAWS, seed: int = SEED) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sample, strata = walk_sample(spark, sf_dir, q, n, seed)
        out = estimate(sample, strata, _walk_aggs(q), CONFIDENCE)
        return out.select(*[F.round(c, 2).alias(c) for c in out.columns])

    return run


def _walk_aggs(q: str) -> dict[str, Agg]:
    return {k: Agg("count_star") if m == "1" else Agg("sum", F.expr(_walk_measure(m))) for k, m in SPECS[q].measures.items()}


def pswr(q: str, seed: int = SEED) -> Callable[[SparkSession, str], DataFrame]:
    """The walk in rounds, until the first measure's half-width is 5 % or the suite's budget is spent.

    The result is the exact values and whether the run kept its promises: see :func:`AqpResult.facts`.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = pswr_run(spark, sf_dir, q, seed)
        register(spark, sf_dir, exact_sql(q))
        return found.facts(spark.sql(_pswr_exact(q)), PSWR_BUDGET, PSWR_ERROR)

    return run


def pswr_run(spark: SparkSession, sf_dir: str, q: str, seed: int = SEED) -> AqpResult:
    s, phase = SPECS[q], count()
    agg = OnlineAggregator(index(spark, sf_dir, s.driver, s.key), AqpConf(progressive_round_size=PSWR_ROUND))
    step = lambda drawn: walked(spark, sf_dir, q, drawn, PSWR_ROUND, seed, f"phase{next(phase)}|")
    return agg.run(_walk_aggs(q), PSWR_BUDGET, PSWR_PILOT, CONFIDENCE, rel_error=PSWR_ERROR, ranges={s.key: s.key_range}, seed=seed, extend=step)


def _pswr_exact(q: str) -> str:
    sums = ", ".join(f"round(cast(coalesce(sum({m}), 0) as double), 2) AS {n}" for n, m in SPECS[q].measures.items())
    return f"SELECT {sums} {SPECS[q].body()}"


def pswr_oracle(q: str) -> str:
    sql = _pswr_exact(q)
    return facts_oracle(f"WITH partsupp AS ({PARTSUPP}) {sql}" if "partsupp" in SPECS[q].sources else sql)


def facts_oracle(exact: str) -> str:
    """The exact values, beside promises that all hold."""
    return f"SELECT *, {', '.join(f'true AS {n}' for n in AqpResult.PROMISES)} FROM ({exact})"


def u32_sql(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def below_sql(text: str, width: str) -> str:
    """A uniform whole number below the width, of the text's first 60 MD5 bits."""
    return f"CAST((CAST(CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT) AS HUGEINT) * {width}) // {1 << 60} AS BIGINT)"


def _source_sql(name: str) -> str:
    if name == "lineitem":
        return f"(SELECT *, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + {tables.JULIAN_EPOCH} AS shipdate_julian FROM lineitem)"
    return f"({PARTSUPP})" if name == "partsupp" else name


def walk_oracle(q: str, n: int = DRAWS, seed: int = SEED) -> str:
    """The same walk in plain SQL with window ranks."""
    s = SPECS[q]
    lo, hi = s.key_range
    inside = " AND ".join([f"{s.key} >= {lo}"] * (lo is not None) + [f"{s.key} < {hi}"] * (hi is not None)) or "true"
    order = ", ".join(dict.fromkeys([s.key, *TIES[s.driver]]))
    label = "'0:' || CAST(dr AS VARCHAR)"
    joins, weight = "", "w"
    met = []
    for k, j in enumerate(s.walk):
        t = f"j{k}"
        src = _source_sql(j.table)
        if j.alias:
            src = f"(SELECT n_nationkey AS {j.alias}_nationkey, n_name AS {j.alias}_name, n_regionkey AS {j.alias}_regionkey FROM nation)"
        if j.many:
            ties = ", ".join(TIES[j.table])
            src = f"(SELECT *, row_number() OVER (PARTITION BY {j.right} ORDER BY {ties}) - 1 AS rk{k}, count(*) OVER (PARTITION BY {j.right}) AS cnt{k} FROM {src})"
            chosen = below_sql(f"'{seed}|match{k}|' || {label}", f"{t}.cnt{k}")
            on = f"{t}.{j.right} = {j.left} AND {t}.rk{k} = {chosen}"
            weight += f" * cnt{k}"
        else:
            on = " AND ".join(f"{t}.{b} = {a}" for a, b in zip(j.left.split(","), j.right.split(","), strict=True))
        joins += f" LEFT JOIN {src} {t} ON {on}"
        met.append(f"{t}.{j.right.split(',')[0]} IS NOT NULL")
    accept = " AND ".join([*met, f"({s.walk_where})"])
    xs = ", ".join(f"CASE WHEN {accept} THEN coalesce(CAST({_walk_measure(m)} AS DOUBLE), 0) * CAST({weight} AS DOUBLE) ELSE 0 END AS {name}" for name, m in s.measures.items())
    outs = ", ".join(
        f"round(sum({name}) / {n}, 2) AS {name}, round({Z} * sqrt(greatest(sum({name} * {name}) - sum({name}) * sum({name}) / {n}, 0) / ({n}.0 * ({n} - 1))), 2) AS {name}_half_ci" for name in s.measures
    )
    drawn = below_sql(f"'{seed}|swr|0:' || CAST(range AS VARCHAR)", "w")
    return f"""
WITH idx AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS rank FROM {_source_sql(s.driver)} WHERE {s.key} IS NOT NULL),
b AS (SELECT min(rank) AS lo, count(*) AS w FROM idx WHERE {inside}),
d AS (SELECT range AS dr, w, lo + {drawn} AS rank FROM range({n}), b),
s AS (SELECT d.dr, d.w, idx.* EXCLUDE (rank) FROM d JOIN idx ON d.rank = idx.rank),
x AS (SELECT {xs} FROM s{joins})
SELECT {outs} FROM x"""


def _hash_sql(key: str) -> str:
    return f"CAST(floor(({u32_sql(f'CAST({key} AS VARCHAR)')} % 100000) / CAST(100000 AS DOUBLE) * 100000) AS INTEGER)"


def _rollup_sql(measures: dict[str, str], sample: str, counts: tuple[str, ...] = ()) -> str:
    parts = ", ".join(f"sum(CAST({m} AS DOUBLE) / vprob) / count(*) * sum(count(*)) OVER () AS {n}" for n, m in measures.items())
    outs = []
    for n in measures:
        est = f"sum({n} * vpsize) / sum(vpsize)"
        err = f"stddev_samp({n}) * sqrt(avg(vpsize)) / sqrt(sum(vpsize)) * 1.96"
        outs.append(f"round({est}, {0 if n in counts else 2}) AS {n}, round({err}, 2) AS {n}_err, round({err} / nullif(abs({est}), 0), 6) AS {n}_rel_ci")
    return f"SELECT {', '.join(outs)} FROM (SELECT {parts}, count(*) AS vpsize FROM {sample} GROUP BY vpart)"


def _rounded(out: DataFrame, measures: dict[str, str]) -> DataFrame:
    return out.select(*[F.round(c, 6 if c.endswith("_rel_ci") else 2).alias(c) for n in measures for c in (n, f"{n}_err", f"{n}_rel_ci")])


def _counts(s: Spec) -> tuple[str, ...]:
    return tuple(n for n, m in s.measures.items() if m == "1")


def universe_query(q: str, rate: float = UNIVERSE_RATE) -> Callable[[SparkSession, str], DataFrame]:
    """Both sides of the join keep the same share of the key values."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = SPECS[q]
        register(spark, sf_dir, s.body())
        for k, (name, key) in enumerate(s.universe.items()):
            kept = universe(spark.table(name), F.expr(key.replace("varchar(20)", "string")), rate)
            kept = kept.withColumnsRenamed({"__vprob": "vprob", "__vpart": "vpart"}) if k == 0 else kept.drop("__vprob", "__vpart")
            kept.createOrReplaceTempView(name)
        cols = ", ".join(f"{m} AS {n}" for n, m in s.measures.items())
        sample = spark.sql(f"SELECT vprob AS __vprob, vpart AS __vpart, {cols} {s.body()}")
        out = _rounded(subsample_estimate(sample, {n: F.col(n) for n in s.measures}, _counts(s)), s.measures)
        register(spark, sf_dir, s.body())  # no sample stays behind under a table's name
        return out

    return run


def universe_oracle(q: str, rate: float = UNIVERSE_RATE) -> str:
    s = SPECS[q]
    ctes, cut = [], -int(-rate * 100000 // 1)
    body = s.sources
    ctes.append(f"partsupp_all AS ({PARTSUPP})")
    for k, (name, key) in enumerate(s.universe.items()):
        src = "partsupp_all" if name == "partsupp" else name
        extra = f", CAST({rate} AS DOUBLE) AS vprob, {_hash_sql(key)} % 100 AS vpart" if k == 0 else ""
        ctes.append(f"u_{name} AS (SELECT *{extra} FROM {src} WHERE {_hash_sql(key)} < {cut})")
        body = ", ".join(f"u_{t} AS {t}" if t.strip() == name else t for t in body.split(", "))
    if "partsupp" not in s.universe:
        body = ", ".join("partsupp_all AS partsupp" if t == "partsupp" else t for t in body.split(", "))
    cols = ", ".join(f"{m} AS {n}" for n, m in s.measures.items())
    ctes.append(f"x AS (SELECT vprob, vpart, {cols} FROM {body} WHERE {s.where})")
    return f"WITH {', '.join(ctes)} {_rollup_sql({n: n for n in s.measures}, 'x', _counts(s))}"


#: Single-table queries have scan-uniform and scan-stratified forms; strata of the latter.
SCANS = {"q1": ("l_returnflag", "l_linestatus"), "q6": ("l_returnflag",), "q22": ("c_mktsegment",)}


def scan_query(q: str, stratified: bool, rate: float = SCAN_RATE) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = SPECS[q]
        base = tables.load(spark, sf_dir, s.driver)
        by = _scan_ids(s.driver)
        sample = scan_stratified(base, list(SCANS[q]), rate, by, seed=SEED) if stratified else scan_uniform(base, rate, by, seed=SEED)
        met = sample.where(s.where)
        out = subsample_estimate(met, {n: F.lit(1.0) if m == "1" else F.expr(m) for n, m in s.measures.items()}, _counts(s))
        return _rounded(out, s.measures)

    return run


def _scan_ids(name: str) -> list[str]:
    """Whole-number columns that tell rows apart as text in the same way everywhere."""
    return ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"] if name == "lineitem" else ["c_custkey"]


def scan_oracle(q: str, stratified: bool, rate: float = SCAN_RATE) -> str:
    s = SPECS[q]
    text = "concat_ws(':', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in _scan_ids(s.driver)) + ")"
    u = f"{u32_sql(f'''concat('{SEED}|scan|', {text})''')} / 4294967296.0"
    part = f"{u32_sql(f'''concat('{SEED}|part|', {text})''')} % 100"
    if not stratified:
        sample = f"SELECT *, CAST({rate} AS DOUBLE) AS vprob, {part} AS vpart FROM {s.driver} WHERE {u} < {rate}"
        return f"WITH x AS (SELECT * FROM ({sample}) WHERE {s.where}) {_rollup_sql(s.measures, 'x', _counts(s))}"
    keys = SCANS[q]
    same = lambda a, b: " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys)
    cols, renamed = ", ".join(keys), ", ".join(f"{k} AS r_{k}" for k in keys)
    met = " AND ".join(f"k.{k} IS NOT DISTINCT FROM c.r_{k}" for k in keys)
    return f"""
WITH g AS (SELECT {cols}, count(*) AS gsize FROM {s.driver} GROUP BY {cols}),
k AS (SELECT t.*, g.gsize FROM {s.driver} t JOIN g ON {same('t', 'g')} WHERE {u.replace('CAST(l_', 'CAST(t.l_').replace('CAST(c_', 'CAST(t.c_')} < ((SELECT sum(gsize) FROM g) * {rate} / (SELECT count(*) FROM g)) / g.gsize),
c AS (SELECT {renamed}, count(*) AS taken FROM k GROUP BY {cols}),
x AS (SELECT k.*, c.taken / CAST(k.gsize AS DOUBLE) AS vprob, {part.replace('CAST(l_', 'CAST(k.l_').replace('CAST(c_', 'CAST(k.c_')} AS vpart FROM k JOIN c ON {met} WHERE {s.where})
{_rollup_sql(s.measures, 'x', _counts(s))}"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f"tpch_{q}_exact": exact(q) for q in SPECS} | {f"tpch_{q}_walk": walk(q) for q in SPECS}
    found |= {f"tpch_{q}_pswr": pswr(q) for q in SPECS}
    found |= {f"tpch_{q}_universe": universe_query(q) for q, s in SPECS.items() if s.universe}
    return found | {f"tpch_{q}_{'stratified' if st else 'uniform'}": scan_query(q, st) for q in SCANS for st in (False, True)}


def oracle_sql() -> dict[str, str]:
    found = {f"tpch_{q}_exact": exact_oracle(q) for q in SPECS} | {f"tpch_{q}_walk": walk_oracle(q) for q in SPECS}
    found |= {f"tpch_{q}_pswr": pswr_oracle(q) for q in SPECS}
    found |= {f"tpch_{q}_universe": universe_oracle(q) for q, s in SPECS.items() if s.universe}
    return found | {f"tpch_{q}_{'stratified' if st else 'uniform'}": scan_oracle(q, st) for q in SCANS for st in (False, True)}
