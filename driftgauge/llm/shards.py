"""Sharding by histogram sort: balanced bytes, one exchange.

Rows get a 63-bit key: 39 bits of the text's hash over 24 bits of the row's, which
is its id's, or of a number of its own where the id is null or repeated. Equal texts are neighbours in key order, and even one text that fills a
third of the table is spread over 2^24 keys, so that it can be cut where the
balance asks for it and nowhere else.

Splitters between shards are found as in histogram sort. Each round counts the
exact bytes and rows between evenly placed probes of the intervals that may
still hold a splitter; a splitter is settled when a probe is within tolerance
of its target or its interval holds one row. Probes stay on borders between
texts until one text alone is left in the interval. Then rows are exchanged
once, and slots are numbered in bins of known first slot, in parallel.

Only DataFrame functions are used. The driver sees counts of at most a few
thousand bins a round, whatever the table's size.

Null text: no bytes, so size 1. Rows with null ids and repeated rows take slots of
their own, and are cut like others. An empty table gives an empty result. The law held is
``bytes``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.llm import common

KEY_BITS, ROW_BITS = 63, 24
_GROUP = 1 << ROW_BITS
#: Bits of the first round's probes, and of a refinement's.
_FIRST, _REFINE = 10, 6


def sort_key(text_hash: Column, row_id: Column, salt: Column) -> Column:
    """The 63-bit key of a row."""
    group = F.shiftrightunsigned(text_hash, 64 - (KEY_BITS - ROW_BITS))
    return F.shiftleft(group, ROW_BITS).bitwiseOR(F.xxhash64(row_id, salt).bitwiseAND(F.lit(_GROUP - 1)))


@dataclass(frozen=True)
class Bin:
    lo: int
    hi: int
    bytes: int
    rows: int


def _tree(spans: list[tuple[int, int, int]], value) -> Column:
    """value(lo, hi, step) of the span that holds the key, by binary decisions; spans are disjoint and sorted."""
    if len(spans) == 1:
        lo, hi, step = spans[0]
        inside = (F.col("__key") >= F.lit(lo)) & (F.col("__key") <= F.lit(hi - 1))
        return F.when(inside, value(lo, hi, step))
    half = len(spans) // 2
    return F.when(F.col("__key") < F.lit(spans[half][0]), _tree(spans[:half], value)).otherwise(_tree(spans[half:], value))


def _histogram(keyed: DataFrame, spans: list[tuple[int, int, int]]) -> dict[tuple[int, int], list[Bin]]:
    """Exact bytes and rows of all steps of each span (lo, hi, step), empty steps included."""
    place = _tree(spans, lambda lo, hi, step: F.expr(f"{lo}L + (__key - {lo}L) div {step}L * {step}L"))
    counted = keyed.select(place.alias("bin"), "__size").where(F.col("bin").isNotNull()).groupBy("bin").agg(F.sum("__size").alias("bytes"), F.count("*").alias("rows"))
    found = {r.bin: (r.bytes, r.rows) for r in counted.collect()}
    return {(lo, hi): [Bin(a, min(a + step, hi), *found.get(a, (0, 0))) for a in range(lo, hi, step)] for lo, hi, step in spans}


def _step(lo: int, hi: int, bits: int) -> int:
    """Width of a probe's step: on borders between texts as long as the span has several texts."""
    step = max(1, (hi - lo) >> bits)
    if hi - lo > _GROUP:
        step = max(_GROUP, step >> ROW_BITS << ROW_BITS)
    return step


@dataclass(frozen=True)
class ShardPlan:
    """Splitters, and the bins with their shard and the first slot of each."""

    splitters: list[int]
    bins: list[tuple[int, int, int, int]]  # lo, hi, shard, first slot
    rounds: int


def plan_shards(keyed: DataFrame, shards: int = 16, tolerance: float = 0.002, bin_share: float = 1 / 256) -> ShardPlan:
    """A plan for rows with ``__key`` and ``__size``.

    ``tolerance`` is the share of a shard's bytes by which a splitter may miss
    its target; ``bin_share`` bounds the share of all rows that is numbered in
    one task. Each refined bin holds more than that share, so the bins number
    at most 2^10 + 2^6 / bin_share for each of nine levels.
    """
    top = 1 << KEY_BITS
    step = top >> _FIRST
    first = _histogram(keyed, [(0, top, step)])[0, top]
    total, rows = sum(b.bytes for b in first), sum(b.rows for b in first)
    allowed, rounds = tolerance * total / shards, 1
    leaves = {b.lo: b for b in first}  # a partition of the key space, refined round by round
    settled: dict[int, int] = {}
    while True:
        spans, below, bounds = {}, 0, []
        order = [leaves[lo] for lo in sorted(leaves)]
        for b in order:
            bounds.append((b, below))
            below += b.bytes
        k = 1
        for b, before in bounds:
            while k < shards and (k * total <= shards * (before + b.bytes)) and total:
                target = k * total / shards
                left, right = target - before, before + b.bytes - target
                settled[k] = b.lo if left <= right else b.hi
                if min(left, right) > allowed and b.rows > 1 and b.hi - b.lo > 1:
                    spans[b.lo] = b
                k += 1
            if b.rows > max(1, bin_share * rows) and b.hi - b.lo > 1:
                spans[b.lo] = b
        if not spans:
            break
        asked = [(b.lo, b.hi, _step(b.lo, b.hi, _REFINE)) for _, b in sorted(spans.items())]
        for (lo, _), parts in _histogram(keyed, asked).items():
            del leaves[lo]
            leaves |= {p.lo: p for p in parts}
        rounds += 1
    splitters = [settled.get(k, top) for k in range(1, shards)]
    bins, shard, slot = [], 0, 0
    for lo in sorted(leaves):
        b = leaves[lo]
        while shard < shards - 1 and splitters[shard] <= b.lo:
            shard, slot = shard + 1, 0
        if b.rows:
            bins.append((b.lo, b.hi, shard, slot))
        slot += b.rows
    return ShardPlan(splitters, bins, rounds)


def assign(keyed: DataFrame, plan: ShardPlan, tie: list[str]) -> DataFrame:
    """``keyed`` with ``shard`` and ``slot``; all its columns go through the one exchange.

    The bins are broadcast: their number is bounded, see :func:`plan_shards`.
    """
    from pyspark.sql import Window

    spark = keyed.sparkSession
    bins = spark.createDataFrame(plan.bins, "__lo long, __hi long, shard int, __first long").withColumn("__cell", F.expr(f"shiftright(__lo, {KEY_BITS - _FIRST})"))
    placed = keyed.withColumn("__cell", F.expr(f"shiftright(__key, {KEY_BITS - _FIRST})"))
    # the last key of a bin is compared, as the end of the key space is no long
    bins = bins.withColumn("__last", F.col("__hi")).drop("__hi")
    joined = placed.join(F.broadcast(bins), (placed["__cell"] == bins["__cell"]) & (F.col("__key") >= F.col("__lo")) & (F.col("__key") <= F.col("__last")), "inner").drop("__cell", "__last")
    rank = F.row_number().over(Window.partitionBy("__lo").orderBy("__key", *tie))
    return joined.withColumn("slot", F.col("__first") + rank - 1).drop("__lo", "__first")


def shard_rows(df: DataFrame, text: str = "text", row_id: str = "doc_id", shards: int = 16, tolerance: float = 0.002) -> DataFrame:
    """``df`` with ``size``, ``shard`` and ``slot``; columns of ``df`` with those names are replaced."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.drop("size", "shard", "slot").withColumn("__size", F.octet_length(body).cast("long") + 1).withColumn("__hash", F.xxhash64(body))
    keyed = _keyed(common.salted(rows, row_id), row_id)
    plan = plan_shards(common.materialize(keyed.select("__key", "__size"), "shard-keys"), shards, tolerance)
    return assign(keyed, _closed(plan), [row_id]).withColumnRenamed("__size", "size").drop("__key")


def _keyed(rows: DataFrame, row_id: str) -> DataFrame:
    return rows.withColumn("__key", sort_key(F.col("__hash"), F.col(row_id), F.col("__salt"))).drop("__hash", "__salt")


def _closed(plan: ShardPlan) -> ShardPlan:
    """The plan with the last key of each bin in place of its end."""
    return ShardPlan(plan.splitters, [(lo, hi - 1, s, f) for lo, hi, s, f in plan.bins], plan.rounds)


def op2_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    body = F.coalesce(F.col("text"), F.lit(""))
    narrow = common.documents(spark, sf_dir).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.crc32(body).alias("text_crc32"), (F.octet_length(body).cast("long") + 1).alias("__size"), F.xxhash64(body).alias("__hash")
    )
    narrow = common.materialize(_keyed(common.salted(narrow, "doc_id"), "doc_id"), "shards")
    placed = assign(narrow, _closed(plan_shards(narrow)), ["doc_id"])
    return placed.select("doc_id", F.col("__size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
