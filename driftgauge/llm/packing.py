"""Conflict-constrained best-fit packing.

Documents go into bins of a fixed capacity. Bins are ordered by what is left
in them; each carries a bitmap of the sources and duplicate clusters it holds.
A document goes to the tightest bin that has room and shares no bit with it:
the search starts at the least sufficient residual and moves to its successor
until a bin is compatible. Blocks of bins keep the bits all their bins share,
so that a source that is everywhere skips whole blocks.

Documents are dealt by the hash of their id to groups of about ``GROUP_BINS``
full bins, longest first within a group. Each group is packed in one pass of
bounded memory; a very frequent source or cluster is spread over all groups.
A document longer than a bin is cut into full bins and a rest that is packed
like any other; nothing is dropped.

Null text has the length of its separator, 1. Null sources and clusters
conflict with nothing. Repeated rows are packed each; they, and rows with a null
id, are dealt to groups one by one. An empty table gives no bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.llm import common

CAPACITY, GROUP_BINS = 32_768, 256
_BLOCK = 64


class Bins:
    """Open bins ordered by residual, in blocks that know their shared bits."""

    def __init__(self) -> None:
        self.blocks: list[list[tuple[int, int]]] = [[]]
        self.shared: list[int] = [0]
        self.bits: dict[int, int] = {}
        self.made = 0

    def _refresh(self, b: int) -> None:
        shared = -1
        for _, i in self.blocks[b]:
            shared &= self.bits[i]
        self.shared[b] = shared if self.blocks[b] else 0

    def _insert(self, residual: int, i: int) -> None:
        b = next((k for k, block in enumerate(self.blocks) if block and block[-1] >= (residual, i)), len(self.blocks) - 1)
        insort(self.blocks[b], (residual, i))
        if len(self.blocks[b]) > _BLOCK:
            half = len(self.blocks[b]) // 2
            self.blocks[b : b + 1] = [self.blocks[b][:half], self.blocks[b][half:]]
            self.shared.insert(b, 0)
            self._refresh(b + 1)
        self._refresh(b)

    def place(self, length: int, bits: int, capacity: int) -> tuple[int, int]:
        """(bin, offset) of an item."""
        for b, block in enumerate(self.blocks):
            if not block or block[-1][0] < length or self.shared[b] & bits:
                continue
            for k in range(bisect_left(block, (length, -1)), len(block)):
                residual, i = block[k]
                if not self.bits[i] & bits:
                    del block[k]
                    self.bits[i] |= bits
                    if block or len(self.blocks) == 1:
                        self._refresh(b)
                    else:
                        del self.blocks[b], self.shared[b]
                    if residual > length:
                        self._insert(residual - length, i)
                    return i, capacity - residual
        i = self.made
        self.made += 1
        self.bits[i] = bits
        if length < capacity:
            self._insert(capacity - length, i)
        return i, 0


def pack_group(items: list[tuple[int, int | None, int | None]], capacity: int) -> list[list[tuple[int, int, int, int]]]:
    """For each (length, source, cluster), its pieces (piece, bin, offset, length); items come longest first."""
    bins = Bins()
    sources = {s: k for k, s in enumerate(sorted({s for _, s, _ in items if s is not None}))}
    often = Counter(c for _, _, c in items if c is not None)
    clusters = {c: len(sources) + k for k, c in enumerate(sorted(c for c, n in often.items() if n > 1))}
    out = []
    for length, source, cluster in items:
        bits = (1 << sources[source] if source is not None else 0) | (1 << clusters[cluster] if cluster in clusters else 0)
        pieces, left = [], length
        while left > 0 or not pieces:
            size = min(left, capacity)
            pieces.append((len(pieces), *bins.place(size, bits, capacity), size))
            left -= size
        out.append(pieces)
    return out


def pack(docs: DataFrame, length: Column, source: Column, cluster: Column, row_id: str = "doc_id", capacity: int = CAPACITY, group_bins: int = GROUP_BINS) -> DataFrame:
    """(row_id, n_units, piece, piece_units, pack_group, bin, bin_offset), a row for each piece."""
    spark = docs.sparkSession
    code = lambda c: F.when(c.isNotNull(), F.xxhash64(c))
    items = common.salted(docs.select(F.col(row_id).cast("long").alias("id"), length.cast("long").alias("len"), code(source).alias("source"), code(cluster).alias("cluster")), "id")
    total = items.agg(F.sum("len")).first()[0] or 0
    groups = max(1, -(-total // (capacity * group_bins)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(doc, n, piece, size, now, b, offset) for (doc, n), pieces in zip(((h[0], h[1]) for h in held), pack_group([h[1:] for h in held], capacity), strict=True) for piece, b, offset, size in pieces]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["id", "n_units", "piece", "piece_units", "pack_group", "bin", "bin_offset"])

        for batch in batches:
            for group, *item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != now and held:
                    yield from flush()
                    held = []
                now = group
                held.append(tuple(item))
        if held:
            yield from flush()

    n = common.shuffle_partitions(spark)
    dealt = items.select(F.expr(f"pmod(xxhash64(id, __salt), {groups}L)").alias("g"), "id", "len", "source", "cluster").repartition(n, "g").sortWithinPartitions("g", F.desc("len"), "id", "cluster", "source")
    packed = dealt.mapInArrow(run, "id long, n_units long, piece long, piece_units long, pack_group long, bin long, bin_offset long")
    return packed.withColumnRenamed("id", row_id)


def pack_documents(docs: DataFrame, text: str = "text", source: str = "source", row_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Packing by UTF-8 bytes and one separator; copies (case and white space apart) are a cluster."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    copies = F.when(body != "", F.lower(F.regexp_replace(body, f"[{common.WS}]+", " ")))
    return pack(docs, F.octet_length(body) + 1, F.col(source), copies, row_id, capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in bins of 32768 bytes."""
    return pack_documents(common.documents(spark, sf_dir))
