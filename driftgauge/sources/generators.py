"""Skewed data for sampling tests: Zipf integers and high-variance date ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.functions.draws import u32, unit


def zipf_int(u: Column, n: int, z: float) -> Column:
    """A Zipf number of 1..n from a uniform one: the inverse of the distribution's integral, exact for z = 1 in shape."""
    if z == 1.0:
        return F.least(F.lit(n), F.floor(F.pow(F.lit(float(n + 1)), u)).cast("long"))
    power = 1.0 - z
    top = (n + 1.0) ** power - 1.0
    return F.least(F.lit(n), F.floor(F.pow(u * top + 1.0, F.lit(1.0 / power))).cast("long"))


@dataclass(frozen=True)
class DateRange:
    first: int
    days: int


def high_variance_ranges(n: int, days: int, width: int = 20, placement: str = "random", seed: int = 0) -> list[DateRange]:
    """n ranges without overlap of about ``width`` days, in front, at the back, or anywhere in 0..days-1."""
    import random

    rnd = random.Random(seed)
    sizes = [max(1, width + rnd.randint(-width // 3, width // 3)) for _ in range(n)]
    free = days - sum(sizes)
    if free < 0:
        raise ValueError("the ranges do not fit")
    if placement == "front":
        gaps = [0] * n
    elif placement == "back":
        gaps = [free] + [0] * (n - 1)
    else:
        cuts = sorted(rnd.randint(0, free) for _ in range(n))
        gaps = [b - a for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
    out, at = [], 0
    for gap, size in zip(gaps, sizes, strict=True):
        at += gap
        out.append(DateRange(at, size))
        at += size
    return out


def skewed_facts(spark: SparkSession, rows: int, days: int = 2000, ranges: list[DateRange] | None = None, z: float = 1.0, seed: int = 0) -> DataFrame:
    """(id, day, amount, late): ``late`` holds for most rows of the ranges and hardly any other; amounts are Zipf."""
    ranges = ranges if ranges is not None else high_variance_ranges(3, days, seed=seed)
    draw = lambda tag: unit(u32(seed, tag, F.col("id")))
    base = spark.range(rows).withColumn("day", F.floor(draw("day") * days).cast("int"))
    inside = F.lit(False)
    for r in ranges:
        inside = inside | F.col("day").between(r.first, r.first + r.days - 1)
    late = F.when(inside, draw("late") < 0.9).otherwise(draw("late") < 0.002)
    return base.withColumn("amount", zipf_int(draw("amount"), 10_000, z).cast("double")).withColumn("late", late)
