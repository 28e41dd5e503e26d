"""Exact Jaccard join of documents on word shingles, in the Jaccard metric space.

Documents with equal shingle sets are one class, found by 128-bit digests; what
follows joins one document of each class, its *head*.

*Neighbourhoods.* Nearly all documents of a corpus are at distance 1 from each
other, so that no choice of pivot documents cuts it: all but a few would go
to the far region of any. The documents that may be within reach are therefore
found by shingles first. With a fixed order of shingles a document
within the wanted distance of x shares one of the first |x| - ceil(t |x|) + 1 of
x; a pair that shares c of them is let through only if what the smaller window
leaves unmatched fits into the distance.

*Pivots of neighbourhoods.* A document's pivot is the first of its neighbours.
Distances to pivots are taken first; two documents of one pivot need no
comparison if both are linked with it, or if their distances to it differ by
more than the wanted distance (triangle inequality). Exact sets decide the rest.

*Crowded shingles* are held by more than ``CROWD`` heads (a licence line, a passage
many share, a text with very many near copies). They come last in the order,
so that only documents made of little else keep them in their windows.
Those, the *crowd*, are near many others, which is where pivots cut well:
they fall into cells that share no window shingle, and cells are cut into Voronoi
regions of pivot documents, recursively and over the cluster
(:mod:`driftgauge.llm.voronoi`).

Components are found in Spark (:mod:`driftgauge.llm.components`).

Shingles are 63-bit hashes of five words. A result changes only where two
shingles of one document, or of one compared pair, have the same hash: for
documents of 300 words about 10^-14 a pair, so 10^-3 over 10^11 compared pairs.
Words are lower-cased in A-Z only. Null or wordless text has no shingles and no
links. A row with a null id gets its size and no component. Rows that share an
id, whatever their texts, are one document for the components: each text's links
are its links. An empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.llm import common
from driftgauge.llm.components import connected_components
from driftgauge.llm.voronoi import Threshold, region_links

#: Shingles that more heads than this hold are crowded.
CROWD = 16
#: Documents whose shingles a task holds at once: a bound of memory, without influence on results.
PART = 10_000
#: Share of the hash space whose shingles a document of up to so many shingles emits.
ZONES = ((100, 1.0), (400, 0.6), (1500, 0.3), (math.inf, 0.25))
_TOP = float(1 << 63)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def zone(n: float) -> float:
    return next(share for most, share in ZONES if n < most)


class Shingler:
    """Sorted distinct shingle hashes of a text."""

    CACHE = 250_000
    _made: dict = {}

    def __init__(self, width: int):
        self.width, self.words = width, common.BoundedCache(self.CACHE)

    @classmethod
    def shared(cls, width: int) -> Shingler:
        if width not in cls._made:
            cls._made[width] = cls(width)
        return cls._made[width]

    def __call__(self, text: str | None) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        # bytes.lower and bytes.split know ASCII only
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.int64)
        cache = self.words
        codes = list(map(cache.get, words))
        if None in codes:
            for i, w in enumerate(words):
                if codes[i] is None:
                    codes[i] = xxh3_64_intdigest(w)
                    cache.put(w, codes[i])
        a = np.array(codes, np.uint64)
        k = min(self.width, len(a))
        n = len(a) - k + 1
        h = a[:n].copy() if k == self.width else a[:n] + np.uint64(k)
        for i in range(1, k):
            h = h * _MULTIPLIER + a[i : i + n]
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        return np.unique((h >> np.uint64(1)).astype(np.int64))


def _lists(values: np.ndarray, lengths: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values))


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def zone_table(docs: DataFrame, width: int, threshold: Threshold) -> DataFrame:
    """One row per document: row id, doc, n, the set's digest (hi, lo), limit, and the shingles of its zone.

    ``limit`` counts the zone's shingles that every possible partner emits too.
    A task emits equal sets once (``emitted``). Shingles that more than ``CROWD``
    different documents of a batch hold are crowded for certain; they leave
    the zones of this and all later batches of the task for ``crowded`` (their
    places) and are announced once in ``marks``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shingle, known = Shingler.shared(width), common.BoundedCache(250_000)
        rid, marked = TaskContext.get().partitionId() << 36, np.empty(0, np.int64)
        for batch in (b.slice(at, PART) for b in batches for at in range(0, b.num_rows, PART)):
            ids, size = batch.column(0), batch.num_rows
            if not size:
                continue
            ns, his, los, limits, zones, emitted = [], [], [], [], [], []
            for doc_id, text in zip(ids.to_pylist(), batch.column(1), strict=True):
                s = shingle(text.as_py())
                n = len(s)
                ns.append(n)
                digest = _digest(s) if n and doc_id is not None else None
                hi, lo = struct.unpack("<qq", digest) if digest else (None, None)
                his.append(hi)
                los.append(lo)
                emitted.append(digest is not None and digest not in known)
                if not emitted[-1]:
                    limits.append(0)
                    zones.append(s[:0])
                    continue
                known.put(digest, True)
                share, sure = zone(n), zone(n * 100 / threshold.percent)
                z = s if share == 1 else s[: np.searchsorted(s, np.int64(share * _TOP))]
                limits.append(len(z) if sure == 1 else int(np.searchsorted(z, np.int64(sure * _TOP))))
                zones.append(z)
            every = np.concatenate(zones)
            values, counts = np.unique(every, return_counts=True)
            hot = np.setdiff1d(values[counts > CROWD], marked, assume_unique=True)
            marked = np.union1d(marked, hot)
            lengths = [len(z) for z in zones]
            place = np.arange(len(every)) - np.repeat(np.cumsum([0, *lengths[:-1]]), lengths).astype(np.int64)
            is_hot = np.zeros(len(every), bool) if not len(marked) else marked[np.minimum(np.searchsorted(marked, every), len(marked) - 1)] == every
            owner = np.repeat(np.arange(size), lengths)
            count = lambda mask: np.bincount(owner[mask], minlength=size).tolist()  # noqa: E731, B023
            cool, warm = count(~is_hot), count(is_hot)
            columns = [
                pa.array(np.arange(rid, rid + size)), ids, pa.array(ns, pa.int32()), pa.array(his, pa.int64()), pa.array(los, pa.int64()), pa.array(emitted), pa.array(limits, pa.int32()),
                _lists(every[~is_hot], cool), _lists(place[~is_hot].astype(np.int32), cool), _lists(place[is_hot].astype(np.int32), warm), _lists(hot, [len(hot), *[0] * (size - 1)]),
            ]
            rid += size
            yield pa.record_batch(columns, names=["rid", "doc", "n", "hi", "lo", "emitted", "limit", "zone", "places", "crowded", "marks"])

    return docs.mapInArrow(run, "rid long, doc long, n int, hi long, lo long, emitted boolean, limit int, zone array<long>, places array<int>, crowded array<int>, marks array<long>")


def _holders(batches: Iterator[pa.RecordBatch], crowd: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (h, hi, lo, rid, at): those of shingles that two or more classes hold, with ``hot``.

    A row of each class is kept, that of its smallest row id. ``at`` is n and
    place in one number, negative for a mark. Of a run that goes on in the next
    batch no more than ``crowd`` rows are held back: beyond, it is crowded.
    """
    held: list[np.ndarray] | None = None
    hot_h, last = None, None

    def emit(cols: list[np.ndarray], hot: np.ndarray, kept: np.ndarray) -> pa.RecordBatch:
        h, hi, lo, rid, at = (c[kept] for c in cols)
        return pa.record_batch([pa.array(h), pa.array(hi), pa.array(lo), pa.array(rid), pa.array((at >> 32).astype(np.int32)), pa.array((at & 0xFFFFFFFF).astype(np.int32)), pa.array(hot[kept])], names=["h", "hi", "lo", "rid", "n", "place", "hot"])

    def decide(cols: list[np.ndarray], open_: bool) -> tuple[np.ndarray, np.ndarray, int]:
        """(hot, kept) of the rows before the last run, or before the end; where it starts."""
        h, at = cols[0], cols[4]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[start, len(h)])
        hot = (np.maximum.reduceat((at < 0).astype(np.int8), start) > 0) | (size > crowd) | ((h[start] == hot_h) if hot_h is not None else False)
        end = int(start[-1]) if open_ and not hot[-1] else len(h)
        kept = np.repeat((size > 1) | hot, size) & (at >= 0)
        kept[end:] = False
        return np.repeat(hot, size), kept, end

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        first = np.r_[last is None or last != tuple(int(c[0]) for c in cols[:3]), np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:3]])]
        last_now = tuple(int(c[-1]) for c in cols[:3])
        cols = [c[first] for c in cols]
        if len(cols[0]):
            hot, kept, end = decide(cols, True)
            if kept.any():
                yield emit(cols, hot, kept)
            hot_h = int(cols[0][-1]) if hot[-1] else None
            held = [c[end:] for c in cols] if end < len(cols[0]) else None
        # rows held back come again with the next batch, so that it compares with them
        last = last_now if held is None else None
    if held is not None:
        hot, kept, _ = decide(held, False)
        if kept.any():
            yield emit(held, hot, kept)


def meetings(zones: DataFrame, partitions: int) -> DataFrame:
    """(h, hi, lo, rid, n, place, hot) of the shingles that two or more classes hold or that are crowded."""
    least = F.lit(-(1 << 63)).cast("long")
    own = zones.select("rid", "hi", "lo", "n", F.explode(F.arrays_zip("zone", "places")).alias("e"))
    own = own.select(F.col("e.zone").alias("h"), "hi", "lo", "rid", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("e.places")).alias("at"))
    marks = zones.where(F.size("marks") > 0).select(F.explode("marks").alias("h"), least.alias("hi"), least.alias("lo"), F.lit(-1).cast("long").alias("rid"), F.lit(-1).cast("long").alias("at"))
    rows = own.union(marks).repartition(partitions, "h").sortWithinPartitions("h", "hi", "lo", "rid")
    crowd = CROWD

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _holders(batches, crowd)

    return rows.mapInArrow(scan, "h long, hi long, lo long, rid long, n int, place int, hot boolean")


def _pairs_of_runs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a < b) of each run of equal shingles, at most ``CROWD`` long, whose sizes can link and which are not both of the crowd."""
    held: list[np.ndarray] | None = None
    for batch in itertools.chain(batches, [None]):
        cols = held
        if batch is not None:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
        if cols is None:
            return
        end = len(cols[0]) if batch is None else int(np.searchsorted(cols[0], cols[0][-1]))
        held = [c[end:] for c in cols]
        h, doc, n, crowd = (c[:end] for c in cols)
        if not end:
            continue
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[start, len(h)])
        out = []
        for gap in range(1, int(size.max())):
            left = np.concatenate([np.arange(s, s + m - gap) for s, m in zip(start[size > gap], size[size > gap], strict=True)])
            out.append(np.stack([left, left + gap]))
        if not out:
            continue
        i, j = np.concatenate(out, axis=1)
        swap = doc[i] > doc[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        ok = ~(crowd[i] & crowd[j]) & (doc[i] != doc[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        i, j = i[ok], j[ok]
        if len(i):
            yield pa.record_batch([pa.array(c) for c in (doc[i], doc[j], n[i], n[j], crowd[i], crowd[j])], names=["a", "b", "na", "nb", "ca", "cb"])


def candidate_pairs(met: DataFrame, heads: DataFrame, threshold: Threshold, partitions: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of heads to compare that are not both of the crowd, and the heads of the crowd."""
    # a crowded place was either left out by the head's own batch or met as crowded
    late = met.where("hot").groupBy("hi", "lo").agg(F.collect_set("place").alias("late"))
    window = lambda n: F.expr(f"{n} - cast(ceil({n} * {threshold.percent} / 100) as int) + 1")
    hot = F.array_union("crowded", F.coalesce("late", F.array().cast("array<int>")))
    state = heads.join(late, ["hi", "lo"], "left").select("rid", "n", "limit", hot.alias("hot"))
    sure = F.col("limit") - F.size(F.filter("hot", lambda x: x < F.col("limit")))
    state = state.select("rid", "hot", (sure < window("n")).alias("crowd"))
    state = common.materialize(state.where((F.size("hot") > 0) | F.col("crowd")), "join-state")
    rest = met.where("not hot").select("h", "rid", "n", "place").join(state, "rid", "left").withColumn("crowd", F.coalesce("crowd", F.lit(False)))
    rank = F.col("place") - F.when(F.col("hot").isNull(), 0).otherwise(F.size(F.filter("hot", lambda x: x < F.col("place"))))
    inside = rest.where(F.col("crowd") | (rank < window("n"))).select("h", "rid", "n", "crowd")
    rows = inside.repartition(partitions, "h").sortWithinPartitions("h", "rid")
    t = threshold.percent

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pairs_of_runs(batches, t)

    pairs = rows.mapInArrow(meet, "a long, b long, na int, nb int, ca boolean, cb boolean")
    counted = pairs.groupBy("a", "b", "na", "nb", "ca", "cb").agg(F.count("*").alias("c"))
    need = f"cast(ceil({t} * (na + nb) / {100 + t}) as int)"
    side = lambda n, c: f"(not {c} and {n} - cast(ceil({n} * {t} / 100) as int) + 1 - c <= {n} - {need})"
    return counted.where(f"{side('na', 'ca')} or {side('nb', 'cb')}").select("a", "b"), state.where("crowd").select("rid")


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(rid, shingles) of the wanted rows (rid, doc, hi, lo); their texts are shuffled, others stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler.shared(width)
        for batch in batches:
            rids, found = [], []
            for rid, hi, lo, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                s = shingle(text.as_py())
                if struct.unpack("<qq", _digest(s)) == (hi, lo):  # other texts may have the same id
                    rids.append(rid)
                    found.append(s)
            if rids:
                yield pa.record_batch([pa.array(rids, pa.int64()), _lists(np.concatenate(found), [len(s) for s in found])], names=["rid", "shingles"])

    return docs.join(wanted, "doc").select("rid", "hi", "lo", "text").mapInArrow(run, "rid long, shingles array<long>").dropDuplicates(["rid"])


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, c, union) of pairs (a, b): the sizes of the sets' intersection and union."""
    left = sets.select(F.col("rid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rid").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("c"), (F.size("sa") + F.size("sb")).cast("long").alias("all"))
    return both.select("a", "b", "c", (F.col("all") - F.col("c")).alias("union"))


def neighbour_links(pairs: DataFrame, sets: DataFrame, threshold: Threshold) -> DataFrame:
    """Links (a, b) that connect whatever linked pairs (a < b) connect, by pivots of neighbourhoods."""
    linked = F.expr(f"100 * c >= {threshold.percent} * union")
    pivot = common.materialize(pairs.groupBy(F.col("b").alias("doc")).agg(F.min("a").alias("pivot")), "join-pivots")
    star = common.materialize(distances(pivot.select(F.col("pivot").alias("a"), F.col("doc").alias("b")), sets), "join-stars")
    far = star.select(F.col("b").alias("doc"), F.col("a").alias("pivot"), (1 - F.col("c") / F.col("union")).alias("far"), linked.alias("near"))
    side = lambda x: far.select(F.col("doc").alias(x), F.col("pivot").alias(f"p{x}"), F.col("far").alias(f"d{x}"), F.col("near").alias(f"l{x}"))
    rest = pairs.join(side("b"), "b").where("a <> pb").join(side("a"), "a", "left")
    # pairs of one pivot: connected by it, or out of reach by the triangle inequality
    known = F.coalesce(F.col("pa") == F.col("pb"), F.lit(False))
    needless = known & ((F.col("la") & F.col("lb")) | (F.abs(F.col("da") - F.col("db")) > threshold.reach + 1e-9))
    more = distances(rest.where(~needless).select("a", "b"), sets)
    return star.union(more).where(linked).select("a", "b")


def crowd_links(sets: DataFrame, threshold: Threshold, partitions: int) -> DataFrame:
    """Links (a, b) that connect whatever is connected among the crowd's documents (doc, shingles)."""
    window = F.expr(f"slice(shingles, 1, size(shingles) - cast(ceil(size(shingles) * {threshold.percent} / 100) as int) + 1)")
    held = sets.select("doc", F.explode(window).alias("h"))
    # written, so that the join stands alone and Spark can split the rows of a very crowded shingle
    first = common.materialize(held.groupBy("h").agg(F.min("doc").alias("m"), F.count("*").alias("k")).where("k > 1").drop("k"), "join-first")
    cells = connected_components(held.join(first, "h").select(F.col("doc").alias("a"), F.col("m").alias("b")).distinct())
    return region_links(cells.select(F.col("component").alias("region"), F.col("node").alias("doc")), sets, threshold, partitions)


def join_components(docs: DataFrame, text: str = "text", row_id: str = "doc_id", percent: int = 80, width: int = 5) -> DataFrame:
    """(row_id, n_shingles, component_id) of every row of ``docs``."""
    spark, threshold = docs.sparkSession, Threshold(percent)
    partitions = common.shuffle_partitions(spark)
    plain = docs.select(F.col(row_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    full = common.materialize(zone_table(plain, width, threshold), "join-zones")
    met = common.materialize(meetings(full.where("emitted or size(marks) > 0"), partitions), "join-meetings")
    # the shingles themselves, most of the table, have done their work
    zones = common.materialize(full.select("rid", "doc", "n", "hi", "lo", "emitted", "limit", "crowded"), "join-documents")
    common.drop_table(full)
    common.release(spark)
    heads = zones.where("emitted").groupBy("hi", "lo").agg(F.min(F.struct("rid", "doc", "n", "limit", "crowded")).alias("e")).select("hi", "lo", "e.*")
    heads = common.materialize(heads, "join-heads")
    pairs, crowd = candidate_pairs(met, heads, threshold, partitions)
    pairs = common.materialize(pairs, "join-pairs")
    common.drop_table(met)
    wanted = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).union(crowd).distinct()
    sets = common.materialize(shingle_sets(plain, heads.select("rid", "doc", "hi", "lo").join(wanted, "rid"), width), "join-sets")
    common.release(spark)
    gathered = common.materialize(sets.join(crowd, "rid", "left_semi").withColumnRenamed("rid", "doc"), "join-crowd")
    links = neighbour_links(pairs, sets, threshold).union(crowd_links(gathered, threshold, partitions))
    # from heads' rows to ids: rows that share an id are one document
    name = heads.select("rid", "doc")
    ends = links.join(name.select(F.col("rid").alias("a"), F.col("doc").alias("da")), "a").join(name.select(F.col("rid").alias("b"), F.col("doc").alias("db")), "b")
    classes = zones.where(F.col("hi").isNotNull()).select("doc", "hi", "lo")
    # written, so that the join stands alone and Spark can split the rows of a very large class; most classes are single
    least = classes.groupBy("hi", "lo").agg(F.min("doc").alias("head"), F.count("*").alias("k")).where("k > 1").drop("k")
    least = common.materialize(least, "join-classes")
    members = classes.join(least, ["hi", "lo"]).select(F.col("doc").alias("a"), F.col("head").alias("b")).where("a <> b")
    parts = connected_components(ends.select(F.col("da").alias("a"), F.col("db").alias("b")).union(members))
    return zones.select("doc", "n").join(parts, F.col("doc") == F.col("node"), "left").select(F.col("doc").alias(row_id), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under five-word shingles at similarity 0.8."""
    return join_components(common.documents(spark, sf_dir))


#: All pairs that share a shingle, and the closure of their links.
OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(b) FROM r WHERE a = doc_id) AS component_id FROM s"""
