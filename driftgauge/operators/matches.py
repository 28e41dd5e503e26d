"""Random-match join: a sampled row meets one uniformly chosen match.

The inverse probability grows by the number of matches, and a row without a
match stays as a rejected draw, so that sums over the join stay unbiased.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgauge.functions.draws import below, u60
from driftgauge.operators.rank_index import RankIndex
from driftgauge.operators.samplers import BROADCAST_DRAWS
from driftgauge.store import write_once


def _narrowed(sample: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], draws: int | None) -> tuple[DataFrame, DataFrame]:
    """Only the rows of a large ``right`` that the draws ask for.

    An outer join can't broadcast the side it keeps, so a large table would be
    shuffled for a few draws. Where the table is beyond Spark's broadcast
    threshold and the number of draws is known to be small, the draws are
    written, and their keys are broadcast in a semi-join over the table's scan.
    """
    spark = sample.sparkSession
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = int(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if draws is None or draws > BROADCAST_DRAWS or size <= limit:
        return sample, right
    sample = write_once(sample, "draws")
    keys = sample.select(*[F.col(a).alias(f"__k{i}") for i, (a, _) in enumerate(pairs)]).distinct()
    same = reduce(Column.__and__, [F.col(b) == F.col(f"__k{i}") for i, (_, b) in enumerate(pairs)])
    return sample, right.join(F.broadcast(keys), same, "left_semi")


def random_match(sample: DataFrame, on: str, index: RankIndex, seed: int = 0, tag: str = "match", columns: list[str] | None = None, draws: int | None = None) -> DataFrame:
    """Join each draw with one match of ``index`` whose key equals ``on``.

    The key statistics tell how many matches there are and where they begin;
    the chosen one is read by rank, so that a frequent key costs no more than a
    rare one. ``draws`` bounds the rows of ``sample`` where it is known.
    """
    stats = index.key_stats().select(F.col("key").alias("__k"), "cnt", "lo_rank")
    sample, stats = _narrowed(sample, stats, [(on, "__k")], draws)
    some = sample.join(stats, F.col(on) == F.col("__k"), "left").drop("__k")
    label = F.concat(F.col("stratum").cast("string"), F.lit(":"), F.col("__draw").cast("string"))
    at = (F.col("lo_rank") + below(u60(seed, tag, label), F.coalesce("cnt", F.lit(1)))).alias("__at")
    keep = [c for c in (columns or index.rows.columns) if c != "rank" and c not in sample.columns]
    some = some.select(*sample.columns, "cnt", at)
    some, right = _narrowed(some, index.rows.select(F.col("rank").alias("__rank"), *keep), [("__at", "__rank")], draws)
    joined = some.join(right, F.col("__at") == F.col("__rank"), "left").drop("__rank")
    met = F.col("cnt").isNotNull()
    out = joined.withColumn("__inv_prob", F.when(met, F.col("__inv_prob") * F.col("cnt")).otherwise(F.col("__inv_prob")))
    before = F.col("__accepted") if "__accepted" in sample.columns else F.lit(True)
    return out.withColumn("__accepted", before & met).drop("cnt", "__at")


def lookup(sample: DataFrame, right: DataFrame, on: list[tuple[str, str]], draws: int | None = None) -> DataFrame:
    """Join with a table of at most one match on pairs (sample column, table column); draws without one stay, rejected."""
    sample, right = _narrowed(sample, right, on, draws)
    marked = right.withColumn("__met", F.lit(True))
    before = F.col("__accepted") if "__accepted" in sample.columns else F.lit(True)
    same = reduce(Column.__and__, [F.col(a) == F.col(b) for a, b in on])
    return sample.join(marked, same, "left").withColumn("__accepted", before & F.coalesce("__met", F.lit(False))).drop("__met")


def accept(sample: DataFrame, predicate: Column) -> DataFrame:
    """Reject draws that fail the predicate (or for which it is unknown)."""
    before = F.col("__accepted") if "__accepted" in sample.columns else F.lit(True)
    return sample.withColumn("__accepted", before & F.coalesce(predicate, F.lit(False)))
