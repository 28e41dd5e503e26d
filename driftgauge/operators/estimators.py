"""Estimates and confidence half-widths from samples.

An aggregate is (kind, expression): ``sum`` of an expression, ``count`` of a
non-null expression, or ``count_star``. A draw that is rejected or whose
expression is null contributes 0 and counts in the sample size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgauge.functions.stats import half_width
from driftgauge.operators.samplers import Stratum


def inv_sample_prob() -> Column:
    """What one accepted draw of a sample stands for."""
    return F.col("__inv_prob")


def sample_prob() -> Column:
    """The chance of a draw; 1 over :func:`inv_sample_prob`."""
    return 1.0 / F.col("__inv_prob")


def running_sample_size(sample: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The draws so far in each row's stratum, counted in the order of the draws."""
    window = Window.partitionBy(*(by or ["stratum"])).orderBy("__draw").rowsBetween(Window.unboundedPreceding, 0)
    return sample.withColumn("__running_n", F.count("*").over(window))


@dataclass(frozen=True)
class Agg:
    """approx_sum(expr), approx_count(expr) or approx_count(*)."""

    kind: str
    expr: Column | None = None

    def value(self) -> Column:
        if self.kind == "count_star":
            return F.lit(1.0)
        if self.expr is None:
            raise ValueError(f"{self.kind} needs an expression")
        if self.kind == "count":
            return F.when(self.expr.isNotNull(), 1.0).otherwise(0.0)
        if self.kind == "sum":
            return F.coalesce(self.expr.cast("double"), F.lit(0.0))
        raise ValueError(f"unknown aggregate {self.kind}")


def approx_sum(expr: Column) -> Agg:
    return Agg("sum", expr)


def approx_count(expr: Column | None = None) -> Agg:
    return Agg("count_star") if expr is None else Agg("count", expr)


def stratum_stats(sample: DataFrame, aggs: dict[str, Agg], by: list[str] | None = None) -> DataFrame:
    """(by.., stratum, __accepted_n, and for each aggregate its sum and sum of squares over the draws).

    Values are divided by nothing and multiplied by ``__inv_prob`` over the
    stratum's weight, which is 1 unless a join has changed it.
    """
    accepted = F.col("__accepted") if "__accepted" in sample.columns else F.lit(True)
    cols = [F.sum(accepted.cast("long")).alias("__accepted_n")]
    for name, agg in aggs.items():
        x = F.when(accepted, agg.value() * F.col("__inv_prob")).otherwise(0.0)
        cols += [F.sum(x).alias(f"{name}__s"), F.sum(x * x).alias(f"{name}__ss")]
    return sample.groupBy(*(by or []), "stratum").agg(*cols)


def combine_strata(stats: DataFrame, strata: list[Stratum], names: list[str], confidence: float, by: list[str] | None = None) -> DataFrame:
    """name and name_half_ci: sum over strata of mean and of variance / draws.

    A stratum without a draw in the statistics contributes 0. One of a single
    draw has no variance, so that the half-width is null. The number of draws
    is the plan's, also for a group that few of them met.
    """
    spark = stats.sparkSession
    plan = spark.createDataFrame([(s.number, s.draws) for s in strata if s.weight > 0], "stratum int, n long")
    full = stats.join(F.broadcast(plan), "stratum")  # at most a few hundred strata
    sums, outs = [], []
    for name in names:
        s, ss, n = F.col(f"{name}__s"), F.col(f"{name}__ss"), F.col("n").cast("double")
        var = F.when(n > 1, F.greatest(ss - s * s / n, F.lit(0.0)) / (n * (n - 1)))
        sums += [F.sum(s / n).alias(f"{name}__mu"), F.sum(var).alias(f"{name}__var"), F.sum(F.when(n <= 1, 1).otherwise(0)).alias(f"{name}__single")]
        outs += [F.coalesce(F.col(f"{name}__mu"), F.lit(0.0)).alias(name), F.when(F.col(f"{name}__single") == 0, half_width(F.col(f"{name}__var"), confidence)).alias(f"{name}_half_ci")]
    return full.groupBy(*(by or [])).agg(*sums).select(*(by or []), *outs)


def estimate(sample: DataFrame, strata: list[Stratum], aggs: dict[str, Agg], confidence: float = 0.95, by: list[str] | None = None) -> DataFrame:
    """Estimates and half-widths of one phase, one row (or one for each group)."""
    return combine_strata(stratum_stats(sample, aggs, by), strata, list(aggs), confidence, by)


def progressive_half_ci(values: DataFrame, strata: list[Stratum], name: str, confidence: float) -> DataFrame:
    """approx_progressive_count_star_half_ci and its like: only the stratified half-width of one aggregate."""
    return combine_strata(values, strata, [name], confidence).select(f"{name}_half_ci")


def ratio(sample: DataFrame, strata: list[Stratum], top: Agg, bottom: Agg, confidence: float = 0.95) -> DataFrame:
    """(ratio, ratio_half_ci) of two sums in one pass, by the delta method: an addition of this engine.

    The half-width is that of the sum of (top - ratio * bottom) over the bottom.
    """
    first = combine_strata(stratum_stats(sample, {"t": top, "b": bottom}), strata, ["t", "b"], confidence)
    r = first.select((F.col("t") / F.nullif("b", F.lit(0.0))).alias("ratio"), F.col("b").alias("__b"))
    row = r.first()
    if row is None or row.ratio is None:
        return r.select("ratio", F.lit(None).cast("double").alias("ratio_half_ci"))
    rest = Agg("sum", top.value() - F.lit(row.ratio) * bottom.value())
    spread = combine_strata(stratum_stats(sample, {"d": rest}), strata, ["d"], confidence)
    return spread.select(F.lit(row.ratio).alias("ratio"), (F.col("d_half_ci") / abs(row["__b"])).alias("ratio_half_ci"))


def combine_phases(phases: list[tuple[float, float, int]]) -> tuple[float, float, int]:
    """(mean, variance, draws) of phases, weighted by their draws."""
    total = sum(n for _, _, n in phases)
    if not total:
        return 0.0, 0.0, 0
    return sum(m * n for m, _, n in phases) / total, sum(v * (n / total) ** 2 for _, v, n in phases), total


def subsample_estimate(sample: DataFrame, measures: dict[str, Column], round_counts: tuple[str, ...] = ()) -> DataFrame:
    """Estimate, error and relative error of sums from a sample with ``__vprob`` and ``__vpart``.

    Each sub-sample extrapolates its own mean to all sampled rows; the estimate
    weighs them by size, and their spread gives the 95 % error.
    """
    parts = sample.groupBy("__vpart").agg(F.count("*").alias("__n"), *[F.sum(m.cast("double") / F.col("__vprob")).alias(name) for name, m in measures.items()])
    # one row for each sub-sample, a hundred by default
    rows = parts.withColumn("__all", F.sum("__n").over(Window.partitionBy(F.lit(1))))
    scaled = rows.select("__n", *[(F.col(m) / F.col("__n") * F.col("__all")).alias(m) for m in measures])
    outs = []
    for m in measures:
        est = F.sum(F.col(m) * F.col("__n")) / F.sum("__n")
        err = F.stddev_samp(m) * F.sqrt(F.avg("__n")) / F.sqrt(F.sum("__n")) * 1.96
        outs += [(F.round(est) if m in round_counts else est).alias(m), err.alias(f"{m}_err"), (err / F.nullif(F.abs(est), F.lit(0.0))).alias(f"{m}_rel_ci")]
    return scaled.agg(*outs)
