"""Exact dedup by content-defined chunk recipes.

A normalised text (each run of ASCII white space is one space) is cut where a
rolling hash of its last bytes meets a mask, so that equal stretches give equal
chunks wherever they stand. A chunk is named by a digest; a *recipe* is the
ordered list of a text's chunk names. The names are verified: contents of equal
name meet and are compared byte by byte, one copy from each task. Should two
contents ever share a name, all is named anew with longer digests. From then on
only recipes move, a few bytes for each 2 KB of text, and texts are equal
exactly if their recipes are.

Null text counts as empty. Rows with a null id are grouped like others and stay
only if no row of their group has an id. Of repeated rows of the staying id one
stays. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgauge.llm import common

#: A cut comes once in so many bytes on average, and at least as often as the larger number says.
MEAN_CHUNK, MOST_CHUNK = 2048, 16384
#: Bytes of a name, longer ones in case of a collision.
NAME_BYTES = (16, 32, 64)
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
#: A fixed random value for each byte.
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def normalise(text: str | None) -> bytes:
    """UTF-8 of the text with each run of ASCII white space as one space."""
    out = (text or "").encode().translate(_SPACES)
    while b"  " in out:
        out = out.replace(b"    ", b" ").replace(b"  ", b" ")
    return out


def cut_points(data: bytes, mean: int = MEAN_CHUNK, most: int = MOST_CHUNK) -> list[int]:
    """Ends of the chunks; the last is the length. They depend on the bytes alone."""
    n = len(data)
    if n <= mean // 4:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for shift in (1, 2, 4, 8):  # the hash of the last 16 bytes, by doubling
        h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
    found = np.flatnonzero((h >> np.uint32(8)) & np.uint32(mean - 1) == 0) + 1
    ends, last = [], 0
    for end in [*found[found >= 16].tolist(), n]:
        while end - last > most:
            last += most
            ends.append(last)
        if end > last:
            ends.append(end)
            last = end
    return ends


def _body(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def recipes(docs: DataFrame, text: str, row_id: str, name_bytes: int) -> DataFrame:
    """(id, body, rid, text_sha256, recipe, names, contents): each task emits the content of a name once.

    ``body`` is a hash of the text as it is, to find the row again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        seen = common.BoundedCache(500_000)
        for batch in batches:
            shas, lists, names, contents = [], [], [], []
            for value in batch.column(1):
                data = normalise(value.as_py())
                shas.append(hashlib.sha256(data).hexdigest())
                recipe, new, bodies, start = [], [], [], 0
                for end in cut_points(data):
                    chunk = data[start:end]
                    start = end
                    name = hashlib.blake2b(chunk, digest_size=name_bytes).digest()
                    recipe.append(name)
                    check = xxh3_128_digest(chunk)
                    if seen.get(name) != check:
                        seen.put(name, check)
                        new.append(name)
                        bodies.append(chunk)
                lists.append(b"".join(recipe))
                names.append(new)
                contents.append(bodies)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(shas, pa.string()), pa.array(lists, pa.binary()), pa.array(names, pa.list_(pa.binary())), pa.array(contents, pa.list_(pa.binary()))], names=["id", "body", "text_sha256", "recipe", "names", "contents"])

    plain = docs.select(F.col(row_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), _body(text).alias("body"))
    return plain.mapInArrow(run, "id long, body long, text_sha256 string, recipe binary, names array<binary>, contents array<binary>").withColumn("rid", F.monotonically_increasing_id())


def collisions(table: DataFrame) -> int:
    """Names that stand for two contents."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, content, wrong = None, None, 0
        for batch in batches:
            for n, c in zip(batch.column(0), batch.column(1), strict=True):
                n = n.as_py()
                if n == name:
                    wrong += c.as_buffer() != content
                else:
                    name, content = n, c.as_buffer()
        yield pa.record_batch([pa.array([wrong], pa.int64())], names=["wrong"])

    chunks = table.where(F.size("names") > 0).select(F.explode(F.arrays_zip("names", "contents")).alias("c")).select(F.col("c.names").alias("name"), F.col("c.contents").alias("content"))
    n = common.shuffle_partitions(table.sparkSession)
    checked = chunks.repartition(n, "name").sortWithinPartitions("name").mapInArrow(compare, "wrong long")
    return checked.agg(F.sum("wrong")).first()[0] or 0


def _groups(docs: DataFrame, text: str, row_id: str, name_sizes: tuple[int, ...]) -> DataFrame:
    for size in name_sizes:
        table = common.materialize(recipes(docs, text, row_id, size), "recipes")
        if not collisions(table):
            break
    else:
        raise ValueError("chunks of different content share the longest name")
    rows = table.select("id", "body", "rid", "text_sha256", "recipe")
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("rid"))
    groups = rows.groupBy("recipe").agg(F.min(place).alias("first"), F.count("*").alias("group_size"))
    # written, so that the join stands alone and Spark can split the rows of a very large group; most recipes are single
    groups = common.materialize(groups.where("group_size > 1"), "recipe-groups")
    own = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("rid"))
    joined = rows.join(groups, "recipe", "left").withColumns({"first": F.coalesce("first", own), "group_size": F.coalesce("group_size", F.lit(1))})
    return joined.select("id", "body", F.col("first.id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), (F.col("rid") == F.col("first.rid")).alias("kept"), "text_sha256")


def exact_groups(docs: DataFrame, text: str = "text", row_id: str = "doc_id", name_sizes: tuple[int, ...] = NAME_BYTES) -> DataFrame:
    """(row_id, keep_id, group_size, kept, text_sha256) of every row."""
    return _groups(docs, text, row_id, name_sizes).select(F.col("id").alias(row_id), "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    stay, body, number = common.fresh(docs, "__stay", "__body", "__twin")
    staying = _groups(docs, text, row_id, NAME_BYTES).where("kept").select(F.col("id").alias(stay), F.col("body").alias(body))
    some = docs.join(staying, F.col(row_id).cast("long").eqNullSafe(F.col(stay)) & (_body(text) == F.col(body)), "left_semi")
    twin = F.row_number().over(Window.partitionBy(row_id, _body(text)).orderBy(row_id))
    return some.withColumn(number, twin).where(F.col(number) == 1).drop(number)


def op6_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents."""
    return exact_groups(common.documents(spark, sf_dir))


OP6_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
