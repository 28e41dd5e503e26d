"""Links of sets in the Jaccard metric, by Voronoi regions of pivot documents.

A region's pivots are some of its documents. Every document of the region is
measured against all pivots and goes to the region of its nearest one. Of a
linked pair (distance at most r), the partner is at most 2 r farther from that
pivot than from its own nearest one, by the triangle inequality; so every
document is also replicated to each pivot's region within that window. 1 is
the greatest distance: a document farther than 1 - r from all pivots goes to
one more region, the far one, as partners of it may share nothing with any pivot.

A pivot has met the whole region and leaves it. Links with pivots make
components; a new region of one component is done, and of its largest
component it keeps only who is at a distance from the pivot at which a member
of another one could be linked. Regions are cut again until they are small;
small ones are compared directly. A cut that would not halve the comparisons
left (documents all about equally far from each other, or few outside the largest
component) is not made: what is outside the region's largest component then
meets all of it, in blocks.

Regions are rows of a table: a large one is dealt over as many tasks as its
rows ask for, each with a copy of the pivots, whose number and bytes are
bounded. Nothing depends on the number of tasks. Only the regions of one
round are counted, never listed, on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgauge.llm import common
from driftgauge.llm.components import connected_components

#: Regions this small are compared directly.
LEAF = 256
#: Pivots of a region, and their shingles all together, at most.
PIVOTS, PIVOT_SHINGLES = 64, 1 << 22
#: Documents that one task measures against a copy of the pivots, or compares with as many others.
SPAN = 256
BLOCK = 512
#: Rounds, after which whatever is left is compared in blocks.
ROUNDS = 12
#: A cut is worth it if it leaves at most this share of the comparisons.
WORTH = 0.5
_EPS = 1e-9


class Threshold:
    """Similarity of ``percent`` / 100, in integers."""

    def __init__(self, percent: int):
        self.percent, self.reach = percent, 1 - percent / 100

    def window(self, n):
        """Length of the window of a set of n shingles."""
        return n + (-n * self.percent) // 100 + 1

    def linked(self, common_, a, b):
        return 100 * common_ >= self.percent * (a + b - common_)


class Forest:
    """Union-find over 0 .. n - 1; a root is its tree's smallest member."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)


class Overlaps:
    """Common members of a set with each of several sets, through an index of theirs."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values = np.concatenate(sets) if sets else np.empty(0, np.int64)
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def common(self, s: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.values, s), np.searchsorted(self.values, s, "right")
        many = high - low
        before = np.cumsum(many) - many
        hits = np.repeat(low - before, many) + np.arange(int(many.sum()))
        return np.bincount(self.owner[hits], minlength=len(self.sizes))


def _groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal values in the first columns; the last column is a list of shingles."""
    now, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[:-1]]
        shingles = batch.columns[-1]
        for i, row in enumerate(zip(*columns, strict=True)):
            if row[:keys] != now:
                if held:
                    yield now, held
                now, held = row[:keys], []
            held.append((*row[keys:], shingles[i].values.to_numpy()))
    if held:
        yield now, held


def _measure(batches: Iterator[pa.RecordBatch], threshold: Threshold) -> Iterator[pa.RecordBatch]:
    """Rows (region, span, pivot or null, doc, shingles), pivots first: each document's label, windows and distances.

    ``label`` is a pivot that the document is linked with, directly or through
    others of the task, or the document itself. ``visits`` names regions by
    their pivots' numbers; the far one has the number of pivots.
    """
    reach = threshold.reach + _EPS
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64())]
    for (region, _), rows in _groups(batches, 2):
        pivots = [r for r in rows if r[0] is not None]
        ids = [r[1] for r in pivots]
        index, forest, own = Overlaps([r[2] for r in pivots]), Forest(len(pivots)), set(ids)
        met: list[tuple] = []  # doc, n, a pivot in reach, visits, distances
        for _, doc, s in rows[len(pivots) :]:
            c = index.common(s)
            near = np.flatnonzero(threshold.linked(c, len(s), index.sizes)).tolist()
            for j in near[1:]:
                forest.join(near[0], j)
            visits, distances = [], []
            if doc not in own:  # a pivot has met everything
                far = 1 - c / (len(s) + index.sizes - c)
                held = np.flatnonzero((far <= far.min() + 2 * reach) & (far < 1))
                visits, distances = held.tolist(), far[held].tolist()
                if far.min() >= 1 - reach:
                    visits.append(len(pivots))
                    distances.append(0.0)
            met.append((doc, len(s), near[0] if near else None, visits, distances))
        out = [(region, doc, n, doc if j is None else ids[forest.root(j)], visits, distances) for doc, n, j, visits, distances in met]
        # pivots that documents of this task connect
        out += [(region, ids[j], 0, ids[forest.root(j)], [], []) for j in range(len(ids)) if forest.root(j) != j]
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["region", "doc", "n", "label", "visits", "far"])


def _labels(ids: list[int], forest: Forest) -> pa.RecordBatch:
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array([ids[forest.root(i)] for i in range(len(ids))], pa.int64())], names=["a", "b"])


def _compare(batches: Iterator[pa.RecordBatch], threshold: Threshold) -> Iterator[pa.RecordBatch]:
    """Rows (region, doc, component, shingles) of small regions: links that connect what is connected."""
    for _, rows in _groups(batches, 1):
        index, forest = Overlaps([r[2] for r in rows]), Forest(len(rows))
        seen: dict[int, int] = {}
        for i, r in enumerate(rows):
            forest.join(seen.setdefault(r[1], i), i)
        if len(seen) < 2:
            continue
        for i, r in enumerate(rows):
            for j in np.flatnonzero(threshold.linked(index.common(r[2]), len(r[2]), index.sizes)).tolist():
                forest.join(i, j)
        yield _labels([r[0] for r in rows], forest)


def _meet(batches: Iterator[pa.RecordBatch], threshold: Threshold) -> Iterator[pa.RecordBatch]:
    """Rows (region, span, block, probe, doc, shingles): links between probes and the other rows."""
    for _, rows in _groups(batches, 3):
        probes, others = [r for r in rows if r[0]], [r for r in rows if not r[0]]
        index, forest = Overlaps([r[2] for r in probes]), Forest(len(rows))
        for i, r in enumerate(others, len(probes)):
            for j in np.flatnonzero(threshold.linked(index.common(r[2]), len(r[2]), index.sizes)).tolist():
                forest.join(i, j)
        yield _labels([r[1] for r in probes + others], forest)


def _spread(rows: DataFrame, sets: DataFrame, partitions: int, keys: list[str], order: list[str], names: list[str]) -> DataFrame:
    """Rows with their shingles, dealt and sorted by the keys."""
    return rows.join(sets, "doc").repartition(partitions, *keys).sortWithinPartitions(*keys, *order).select(*names, "shingles")


def _round(large: DataFrame, sets: DataFrame, threshold: Threshold, partitions: int, level: int) -> DataFrame:
    """Measure the rows (region, doc, n, members, widest, inner) of large regions against their pivots."""
    most = f"least({PIVOTS}, ceil(members / {LEAF}) + 1, greatest(1, cast({PIVOT_SHINGLES} / widest as long)))"
    # documents outside the largest component first: what they are linked with is what is not known yet
    order = Window.partitionBy("region").orderBy("inner", F.xxhash64("doc", F.lit(level)), "doc")
    pivots = large.withColumn("pivot", F.row_number().over(order)).where(f"pivot <= {PIVOTS}").where(f"pivot <= {most}")
    pivots = common.materialize(pivots.select("region", "doc", "members", (F.col("pivot") - 1).cast("long").alias("pivot")), "voronoi-pivots")
    spans = F.expr(f"cast(ceil(members / {SPAN}) as int)")
    copies = pivots.select("region", "doc", "pivot", F.explode(F.sequence(F.lit(0), spans - 1)).alias("span"))
    dealt = large.select("region", "doc", F.lit(None).cast("long").alias("pivot"), F.pmod(F.xxhash64("doc", F.lit(level + 1)), spans).cast("int").alias("span"))
    rows = _spread(copies.unionByName(dealt), sets, partitions, ["region", "span"], [F.col("pivot").asc_nulls_last(), "doc"], ["region", "span", "pivot", "doc"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _measure(batches, threshold)

    return common.materialize(rows.mapInArrow(run, "region long, doc long, n long, label long, visits array<int>, far array<double>"), "voronoi-measured")


def _children(measured: DataFrame, parts: DataFrame, threshold: Threshold, level: int) -> tuple[DataFrame, DataFrame]:
    """Rows (region, doc, n, inner) of the new regions that hold more than one component, and rows (region, doc, inner) of those not worth a cut."""
    met = measured.where(F.size("visits") > 0).join(parts, F.col("doc") == F.col("node"), "left").withColumn("component", F.coalesce("component", "doc"))
    met = common.materialize(met.select(F.col("region").alias("parent"), "doc", "n", "component", "visits", "far"), "voronoi-met")
    visits = met.select("parent", "doc", "n", "component", F.explode(F.arrays_zip("visits", "far")).alias("v"))
    rows = visits.select(F.xxhash64("parent", "v.visits", F.lit(level)).alias("child"), "parent", "doc", "n", "component", F.col("v.far").alias("far"))

    def largest(counted: DataFrame, key: list[str]) -> DataFrame:
        """The largest component, rows, and rows outside it, of what holds several."""
        found = counted.groupBy(*key).agg(F.max(F.struct("k", "component")).alias("m"), F.sum("k").alias("now"), F.count("*").alias("parts")).where("parts > 1")
        return found.select(*key, F.col("m.component").alias("top"), "now", (F.col("now") - F.col("m.k")).alias("outsiders"))

    per = rows.groupBy("child", "parent", "component").agg(F.count("*").alias("k"), F.min("far").alias("low"), F.max("far").alias("high"))
    per = common.materialize(per, "voronoi-parts")
    top = largest(per, ["child", "parent"])
    whole = largest(met.groupBy("parent", "component").agg(F.count("*").alias("k")), ["parent"])
    cost = f"now * (outsiders + {PIVOTS})"
    after = top.groupBy("parent").agg(F.sum(F.expr(cost)).alias("after"))
    verdict = common.materialize(whole.join(after, "parent", "left").select("parent", "top", F.expr(f"coalesce(after, 0) <= {WORTH} * {cost}").alias("cut")), "voronoi-verdicts")
    cut = verdict.where("cut").select("parent")
    # who of the largest component may be linked with someone outside it
    bounds = per.join(top.join(cut, "parent").select("child", "top"), "child").where("component <> top").groupBy("child", "top").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    bounds = common.materialize(bounds, "voronoi-bounds")
    reach = threshold.reach + 2 * _EPS
    kept = rows.join(bounds, "child").withColumn("inner", F.col("component") == F.col("top"))
    kept = kept.where(~F.col("inner") | F.col("far").between(F.col("low") - reach, F.col("high") + reach)).select(F.col("child").alias("region"), "doc", "n", "inner")
    left = met.join(verdict.where("not cut").drop("cut"), "parent").select(F.col("parent").alias("region"), "doc", (F.col("component") == F.col("top")).alias("inner"))
    return kept, left


def _blocks(rows: DataFrame, sets: DataFrame, threshold: Threshold, partitions: int) -> DataFrame:
    """Links between what is outside the largest component of a region and all of it, in tasks of bounded size."""
    sizes = rows.groupBy("region").agg(F.count("*").alias("members"), F.sum(F.expr("cast(not inner as int)")).alias("outer"))
    sizes = common.materialize(sizes.select("region", F.expr(f"cast(ceil(members / {BLOCK}) as int)").alias("spans"), F.expr(f"cast(ceil(outer / {BLOCK}) as int)").alias("blocks")), "voronoi-sizes")
    rows = rows.join(sizes, "region")
    deal = lambda n, seed: F.pmod(F.xxhash64("doc", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    probes = rows.where("not inner").select("region", every("spans").alias("span"), deal("blocks", 1).alias("block"), F.lit(True).alias("probe"), "doc")
    others = rows.select("region", deal("spans", 2).alias("span"), every("blocks").alias("block"), F.lit(False).alias("probe"), "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _meet(batches, threshold)

    return _spread(probes.union(others), sets, partitions, ["region", "span", "block"], ["probe", "doc"], ["region", "span", "block", "probe", "doc"]).mapInArrow(run, "a long, b long")


def region_links(cells: DataFrame, sets: DataFrame, threshold: Threshold, partitions: int) -> DataFrame:
    """Links (a, b) that connect whatever is connected within a region.

    ``cells`` has (region, doc), ``sets`` (doc, shingles) without repeated
    documents. Links lead from a document to one it is connected with inside
    its component, not always directly.
    """
    spark = cells.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    lengths = sets.select("doc", F.size("shingles").cast("long").alias("n"))
    rows = cells.join(lengths, "doc").select("region", "doc", "n", F.lit(False).alias("inner"))
    leaves, stuck, parts = [], [], None
    for level in range(ROUNDS + 1):
        rows = common.materialize(rows, "voronoi-rows")
        sizes = rows.groupBy("region").agg(F.count("*").alias("members"), F.max("n").alias("widest"), F.sum(F.expr("cast(not inner as int)")).alias("outer"))
        sizes = common.materialize(sizes.where("members > 1"), "voronoi-sizes")
        sized = rows.join(sizes, "region")
        leaves.append(sized.where(f"members <= {LEAF}").select("region", "doc"))
        large = sized.where(f"members > {LEAF}")
        if sizes.where(f"members > {LEAF}").isEmpty():
            break
        if level == ROUNDS:
            stuck.append(common.materialize(large.select("region", "doc", "inner"), "voronoi-stuck"))
            break
        measured = _round(large, sets, threshold, partitions, level)
        links = common.materialize(links.union(measured.where("doc <> label").select(F.col("doc").alias("a"), F.col("label").alias("b"))), "voronoi-links")
        parts = connected_components(links)
        rows, left = _children(measured, parts, threshold, level)
        stuck.append(common.materialize(left, "voronoi-stuck"))
    for table in stuck:
        if not table.isEmpty():
            links = common.materialize(links.union(_blocks(table, sets, threshold, partitions)), "voronoi-links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _compare(batches, threshold)

    small = leaves[0]
    for table in leaves[1:]:
        small = small.union(table)
    known = F.col("doc") if parts is None else F.coalesce("component", "doc")
    small = small if parts is None else small.join(parts, F.col("doc") == F.col("node"), "left")
    small = small.select("region", "doc", known.alias("component"))
    found = _spread(small, sets, partitions, ["region"], ["doc"], ["region", "doc", "component"]).mapInArrow(run, "a long, b long")
    return links.union(common.materialize(found, "voronoi-links")).where("a <> b")
