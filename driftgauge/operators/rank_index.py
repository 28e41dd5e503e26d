"""Rank index: a key-sorted copy of a table with a dense rank.

It takes the place of a count-augmented B-tree. The weight of a key range is
the difference of two ranks, a uniform draw is a uniform rank, and fetching a
draw is an equi-join on the rank.

The table is range-exchanged and sorted on (key, tie-break) once, and written.
Ranks come from each partition's row count, so that neither a frequent key nor
the whole table passes through one task. Its files are ordered by rank: a rank
range skips row groups by their statistics. Rows with a null key get no rank,
as no range holds them. The tie-break columns should make rows unique; if they
do not, equal rows may swap ranks.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgauge.store import write_once

_LOCAL = (1 << 33) - 1


@dataclass
class RankIndex:
    """``rows`` has all columns of the table and ``rank``; ``weight`` is the number of rows."""

    rows: DataFrame
    key: str
    weight: int
    _bounds: dict = field(default_factory=dict)
    _stats: DataFrame | None = None

    def key_stats(self) -> DataFrame:
        """(key, cnt, lo_rank, hi_rank) with hi exclusive; written when first asked for."""
        if self._stats is None:
            stats = self.rows.groupBy(self.key).agg(F.count("*").alias("cnt"), F.min("rank").alias("lo_rank"))
            self._stats = write_once(stats.select(F.col(self.key).alias("key"), "cnt", "lo_rank", (F.col("lo_rank") + F.col("cnt")).alias("hi_rank")), "key-stats")
        return self._stats

    def bounds(self, key_range: tuple | None = None) -> tuple[int, int]:
        """Ranks [lo, hi) of keys in [low, high); either end may be None."""
        low, high = key_range or (None, None)
        if low is None and high is None:
            return 0, self.weight
        if (low, high) not in self._bounds:
            value = F.col(self.key)
            tests = [value >= F.lit(low)] * (low is not None) + [value < F.lit(high)] * (high is not None)
            found = self.rows.where(reduce(Column.__and__, tests)).agg(F.min("rank"), F.max("rank")).first()
            self._bounds[low, high] = (0, 0) if found[0] is None else (found[0], found[1] + 1)
        return self._bounds[low, high]

    def range_weight(self, key_range: tuple | None = None) -> int:
        lo, hi = self.bounds(key_range)
        return hi - lo


def append(index: RankIndex, more: DataFrame, tie: list[str] | tuple[str, ...]) -> RankIndex:
    """The index of its rows and more of the same columns, in a new place; the old one stays valid for who still reads it.

    Ranks of all later keys move, so that the rows are exchanged and written
    anew: for a table that grows by days, an index for each stretch of time and
    one estimate for each (they add up like strata) is cheaper.
    """
    kept = [c for c in index.rows.columns if c != "rank"]
    return build_rank_index(index.rows.select(*kept).unionByName(more.select(*kept)), index.key, tie)


def build_rank_index(df: DataFrame, key: str, tie: list[str] | tuple[str, ...], columns: list[str] | None = None) -> RankIndex:
    """An index of ``df`` on ``key``. ``columns`` keeps only those (an index that covers its queries is narrower)."""
    kind = df.schema[key].dataType.typeName()
    if kind in ("map", "variant", "struct", "array"):
        raise ValueError(f"{key} of type {kind} can't be an index key")
    keep = list(dict.fromkeys([*(columns or df.columns), key, *tie]))
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(key), *[F.col(c) for c in tie if c != key]]
    placed = df.select(*keep).where(F.col(key).isNotNull()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    numbered = write_once(placed.withColumn("__at", F.monotonically_increasing_id()), "index")
    part, local = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit(_LOCAL))
    before, total = {}, 0
    # one number for each partition
    for r in sorted(numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        before[r.part], total = total, total + r.n
    if not before:
        return RankIndex(numbered.withColumn("rank", F.lit(0).cast("long")).drop("__at"), key, 0)
    offsets = spark.createDataFrame(list(before.items()), "part long, before long")
    ranked = numbered.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + local).select(*keep, "rank")
    return RankIndex(write_once(ranked, "index"), key, total)
