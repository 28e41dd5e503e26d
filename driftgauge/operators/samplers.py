"""Samplers.

Every sampler returns a DataFrame. Those with replacement add ``__draw`` (number
of the draw), ``__inv_prob`` (what one accepted draw stands for) and, where a
predicate is given, ``__accepted``; a draw that fails it stays, as it counts in
the sample size.
"""

from __future__ import annotations

import hashlib
import time
import warnings
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgauge.functions.draws import below, hash_block, md5_u32, u32, u60, unit
from driftgauge.operators.rank_index import RankIndex

#: Draws up to which the draw table (three longs a row) is broadcast.
BROADCAST_DRAWS = 100_000
#: Rows that a sample may bring through one task; of larger ones, a share of 2^-SAMPLE_BITS of the table does.
TOP_ROWS, SAMPLE_BITS = 100_000, 16
#: A sampler is called inefficient when it accepts less than one draw in so many.
ATTEMPTS_PER_ACCEPTED = 1000


class Sampler(Protocol):
    """What a custom sampling method offers: a sample of a table, and a guess of its size."""

    def sample(self, df: DataFrame, *args, seed: int | None = None) -> DataFrame: ...

    def estimate_rows(self, rows: int, *args) -> int: ...


def checked_size(n, name: str = "sample size") -> int:
    if n is None:
        raise ValueError(f"{name} must not be null")
    if n < 0:
        raise ValueError(f"{name} must not be negative")
    return int(n)


def checked_percent(p) -> float:
    if p is None or not 0 <= p <= 100:
        raise ValueError("sample percentage must be between 0 and 100")
    return float(p)


def estimated_rows(n: int | None, default: int = 1000) -> int:
    """The planner's guess for a sampler of n draws: n, or the default where n is unknown or not positive."""
    return n if n and n > 0 else default


@dataclass(frozen=True)
class Stratum:
    """Ranks [lo, hi) and the draws to take from them."""

    number: int
    lo: int
    hi: int
    draws: int

    @property
    def weight(self) -> int:
        return self.hi - self.lo


def draw_table(spark, strata: list[Stratum], seed, tag: str = "swr") -> DataFrame:
    """(stratum, __draw, rank, __inv_prob): uniform ranks with replacement within each stratum."""
    rows = [(s.number, s.lo, s.weight, s.draws) for s in strata if s.draws > 0 and s.weight > 0]
    plan = spark.createDataFrame(rows, "stratum int, lo long, w long, n long")
    if len(rows) == 1:
        s, lo, w, n = rows[0]
        draws = spark.range(n).select(F.lit(s).alias("stratum"), F.lit(lo).alias("lo"), F.lit(w).cast("long").alias("w"), F.col("id").alias("__draw"))
    else:
        draws = plan.select("stratum", "lo", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("__draw"))
    number = u60(seed, tag, F.concat(F.col("stratum").cast("string"), F.lit(":"), F.col("__draw").cast("string")))
    return draws.select("stratum", "__draw", (F.col("lo") + below(number, F.col("w"))).alias("rank"), F.col("w").cast("double").alias("__inv_prob"))


def swr_strata(index: RankIndex, strata: list[Stratum], seed: int = 0, predicate: Column | None = None, columns: list[str] | None = None, tag: str = "swr") -> DataFrame:
    """Draws with replacement from several rank ranges, in one job.

    The draw table is broadcast while it is small (its size is known: the sum
    of the strata's draws); beyond that the ranks are shuffled.
    """
    lo, hi = min(s.lo for s in strata), max(s.hi for s in strata)
    keep = [F.col(c) for c in (columns or [c for c in index.rows.columns if c != "rank"])]
    rows = index.rows.where((F.col("rank") >= lo) & (F.col("rank") < hi)).select("rank", *keep)
    draws = draw_table(index.rows.sparkSession, strata, seed, tag)
    total = sum(s.draws for s in strata)
    joined = rows.join(F.broadcast(draws) if total <= BROADCAST_DRAWS else draws, "rank")
    if predicate is not None:
        joined = joined.withColumn("__accepted", F.coalesce(predicate, F.lit(False)))
    return joined


def swr(index: RankIndex, n: int, seed: int | None = None, key_range: tuple | None = None, predicate: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """n uniform draws with replacement from a key range; no rows for n = 0 or an empty range."""
    n = checked_size(n)
    lo, hi = index.bounds(key_range)
    seed = time.time_ns() if seed is None else seed
    strata = [Stratum(0, lo, hi, n)]
    if n == 0 or hi <= lo:
        return swr_strata(index, [Stratum(0, 0, max(index.weight, 1), 1)], seed, predicate, columns).limit(0)
    return swr_strata(index, strata, seed, predicate, columns)


def warn_rejections(accepted: int, attempted: int) -> bool:
    """Warn when hardly any draw meets the predicate."""
    poor = attempted >= ATTEMPTS_PER_ACCEPTED and accepted * ATTEMPTS_PER_ACCEPTED < attempted
    if poor:
        warnings.warn(f"only {accepted} of {attempted} draws meet the predicate", stacklevel=2)
    return poor


def _row_text(by: list[str]) -> Column:
    return F.concat_ws(":", *[F.col(c).cast("string") for c in by])


def bernoulli(df: DataFrame, percent: float, by: list[str], seed: int = 0) -> DataFrame:
    """Each row by itself with the given chance, by a hash of its identifying columns."""
    cut = int(round(checked_percent(percent) / 100 * (1 << 32)))
    return df.where(u32(seed, "bernoulli", _row_text(by)) < F.lit(cut))


def system(df: DataFrame, percent: float, by: list[str], seed: int = 0, blocks: int = 1024) -> DataFrame:
    """Whole hash blocks of rows with the given chance each."""
    cut = int(round(checked_percent(percent) / 100 * (1 << 32)))
    block = md5_u32(F.concat(F.lit("block|"), _row_text(by))) % blocks
    return df.where(u32(seed, "system", block) < F.lit(cut))


def system_rows(df: DataFrame, n: int, by: list[str], seed: int = 0) -> DataFrame:
    """Exactly min(n, rows) rows without replacement: those of the smallest hashes.

    Small n is a bounded top-n; the n itself is the method's argument.
    """
    n = checked_size(n)
    drawn = df.withColumn("__u", u32(seed, "rows", _row_text(by)))
    if n <= TOP_ROWS:
        return drawn.orderBy("__u", *by).limit(n).drop("__u")
    # many rows: all of the bins below the n-th row's, and the first ones of its bin alone are put in order
    bin_ = F.shiftright("__u", 32 - SAMPLE_BITS)
    below_, last = 0, None
    for r in sorted(drawn.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n")).collect()):
        if below_ + r.n >= n:
            last = r.bin
            break
        below_ += r.n
    if last is None:
        return df
    return drawn.where(bin_ < last).union(drawn.where(bin_ == last).orderBy("__u", *by).limit(n - below_)).drop("__u")


def system_time(df: DataFrame, millis: float, by: list[str], seed: int = 0, blocks: int = 64) -> DataFrame:
    """Rows of blocks that are read in a random order until the time is over.

    Blocks are the table's files where it has several, so that each is read
    once and alone; otherwise hash blocks of its rows. A block is counted to
    know how long it takes; the blocks read are the result.
    """
    if millis is None or millis < 0:
        raise ValueError("sample collection time must not be negative")
    deadline = time.monotonic() + millis / 1000
    files = sorted(df.inputFiles())
    if len(files) >= 8 and "_metadata" not in df.columns:
        at = F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0)
        names = [f.rpartition("/")[2] for f in files]
    else:
        names, at = [str(b) for b in range(blocks)], (md5_u32(F.concat(F.lit("block|"), _row_text(by))) % blocks).cast("string")
    taken: list[str] = []
    for name in sorted(names, key=lambda b: hashlib.md5(f"{seed}|{b}".encode()).digest()):
        if time.monotonic() >= deadline:
            break
        df.where(at == name).count()
        taken.append(name)
    return df.where(at.isin(taken) if taken else F.lit(False))


def reservoir(df: DataFrame, n: int, by: list[str], seed: int = 0) -> DataFrame:
    """A fixed-size sample without replacement, as a reservoir gives it: the n rows of the smallest hash."""
    return system_rows(df, n, by, seed)


def block_sample(blocks: int, n: int, seed: int = 0) -> list[int]:
    """min(n, blocks) block numbers in ascending order, each set equally likely (selection sampling)."""
    import random

    rnd, taken = random.Random(seed), []
    n = min(checked_size(n), blocks)
    for b in range(blocks):
        if rnd.random() * (blocks - b) < n - len(taken):
            taken.append(b)
    return taken


def scan_uniform(df: DataFrame, rate: float, by: list[str], parts: int = 100, seed: int = 0) -> DataFrame:
    """Rows with chance ``rate``, with ``__vprob`` and one of ``parts`` sub-samples in ``__vpart``."""
    text = _row_text(by)
    kept = df.where(unit(u32(seed, "scan", text)) < rate)
    return kept.withColumn("__vprob", F.lit(float(rate))).withColumn("__vpart", (u32(seed, "part", text) % parts).cast("int"))


def scan_stratified(df: DataFrame, strata: list[str], rate: float, by: list[str], parts: int = 100, seed: int = 0) -> DataFrame:
    """About the same number of rows from every stratum; ``__vprob`` is the share that was taken.

    A stratum's chance is (rows * rate / strata) / its rows. Null is a stratum
    like any other. Sizes and counts are partial aggregates; the two joins bring
    one row for each stratum.
    """
    sizes = df.groupBy(*strata).agg(F.count("*").alias("__size"))
    whole = sizes.agg(F.coalesce(F.sum("__size"), F.lit(0)).alias("rows"), F.count("*").alias("strata")).first()
    text = _row_text(by)

    def matched(left: DataFrame, right: DataFrame) -> DataFrame:
        renamed = right.select(*[F.col(c).alias(f"__r_{c}") for c in strata], *[c for c in right.columns if c not in strata])
        same = F.lit(True)
        for c in strata:
            same = same & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
        return left.join(renamed, same).drop(*[f"__r_{c}" for c in strata])

    chance = F.lit(whole.rows * rate / max(whole.strata, 1)) / F.col("__size")
    kept = matched(df, sizes).where(unit(u32(seed, "scan", text)) < chance)
    taken = kept.groupBy(*strata).agg(F.count("*").alias("__taken"))
    out = matched(kept, taken)
    return out.withColumn("__vprob", F.col("__taken") / F.col("__size")).withColumn("__vpart", (u32(seed, "part", text) % parts).cast("int")).drop("__taken", "__size")


def universe(df: DataFrame, key: Column, rate: float, parts: int = 100, modulus: int = 100_000, blocks: int = 100_000) -> DataFrame:
    """All rows of a share of the key values: both sides of a join keep the same keys."""
    block = hash_block(key, modulus, blocks)
    cut = -int(-rate * blocks // 1)
    return df.where(block < cut).withColumn("__vprob", F.lit(float(rate))).withColumn("__vpart", (block % parts).cast("int"))
