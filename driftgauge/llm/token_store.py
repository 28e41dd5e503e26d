"""Token-id output with a shared zstandard dictionary.

A *token store* is a folder of two Parquet tables. Parquet only carries the
bytes, so that the store works on every file system Spark can reach:

``dictionary``
    one row: ``hash`` (sha256 of the bytes, binary) and ``bytes``.
``blocks``
    one row for each block: ``bucket``, ``seq`` (order of blocks in a bucket),
    ``first_id``, ``last_id``, ``n_docs``, ``n_tokens``, ``tokens_before`` (in
    the bucket), and ``block``, the bytes described at :data:`HEADER`.

Buckets are ranges of ``doc_id`` (or parts of the rows of one frequent id), so (bucket, seq, position in block) is the
order of ``doc_id``, nulls first. In a block every document is a zstandard
frame of its own, compressed with the shared dictionary; the offset index at
the block's head gives access to one short document without the others.

Null text counts as empty. A document always ends with the end id, so an empty
one has one token. Repeated rows are stored as often as they come. An empty table
gives an empty store.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.llm import common, units

#: magic, version, bytes of an id, end id, documents, sha256 of the dictionary; then the index, then the frames.
HEADER = struct.Struct("<4sHHII32s")
#: doc_id, 1 if doc_id is null, tokens, end of the frame counted from the first frame's start.
ENTRY = struct.Struct("<qIIQ")
MAGIC, VERSION = b"DGTS", 1
BLOCK_BYTES = 4 << 20


class IdEncoder:
    """Ids of whole texts as the tokenizers library gives them."""

    #: Bytes of text that are encoded together.
    CALL_BYTES = 3 << 19
    #: Pieces that the library encodes in one call.
    CALL_PIECES = 4096
    _made: dict = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(common.tokenizer_path(path))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() < 1 << 16 else 4
        self.table = units.PieceTable(self._pieces)

    @classmethod
    def shared(cls, path: str) -> IdEncoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _pieces(self, texts: list[str]) -> list[list[int]]:
        # in parts, as the library's result holds far more than the ids
        parts = (texts[i : i + self.CALL_PIECES] for i in range(0, len(texts), self.CALL_PIECES))
        return [e.ids for part in parts for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, texts: Iterable[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text (UTF-8), in calls of bounded size."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= self.CALL_BYTES:
                yield from units.encode_texts(held, self.table, self.whole, self.special)
                held, size = [], 0
        if held:
            yield from units.encode_texts(held, self.table, self.whole, self.special)


def _serialize(ids: np.ndarray, end_id: int, width: int) -> bytes:
    """The ids and the end id, little-endian."""
    return np.append(ids, np.uint32(end_id)).astype(f"<u{width}").tobytes()


def _deserialize(raw: bytes, width: int) -> bytes:
    return raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, size: int = 112_640, sample_rows: int = 1000, sample_bytes: int = 65_536, rows: int | None = None) -> bytes:
    """A zstandard dictionary for serialized id arrays.

    Fitted on at most ``sample_rows`` documents (those of the smallest hash of
    ``doc_id`` among texts of up to ``sample_bytes`` bytes); it changes the
    size of the store, never its contents. With too few samples the dictionary
    is their plain contents, with none it is empty. ``rows`` is the number of
    documents where it is known.
    """
    import zstandard

    # of the smallest hashes only, as every task would send sample_rows texts to the driver otherwise
    place, share = F.xxhash64("doc_id"), min(1.0, 3 * sample_rows / max(docs.count() if rows is None else rows, 1))
    few = docs.where((place <= common.hash_below(share)) & F.octet_length("text").between(1, sample_bytes))
    texts = few.orderBy(place, "doc_id").limit(sample_rows).select("text").collect()
    encoder = IdEncoder.shared(tokenizer)
    samples = [_serialize(ids, end_id, encoder.width) for ids in encoder(r.text.encode() for r in texts)]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _codec_dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_block(entries: list[tuple[int | None, int, bytes]], width: int, end_id: int, dict_hash: bytes) -> bytes:
    """A block of (doc_id, tokens, frame) entries."""
    index, end = [], 0
    for doc_id, n, frame in entries:
        end += len(frame)
        index.append(ENTRY.pack(0 if doc_id is None else doc_id, doc_id is None, n, end))
    return HEADER.pack(MAGIC, VERSION, width, end_id, len(entries), dict_hash) + b"".join(index) + b"".join(e[2] for e in entries)


class Block:
    """Random access to the documents of a block."""

    def __init__(self, raw: bytes, dictionary: bytes):
        import zstandard

        magic, version, self.width, self.end_id, self.n_docs, dict_hash = HEADER.unpack_from(raw)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token block of this version")
        if dict_hash != hashlib.sha256(dictionary).digest():
            raise ValueError("the block was written with another dictionary")
        self.raw, self.start = raw, HEADER.size + ENTRY.size * self.n_docs
        self.decompressor = zstandard.ZstdDecompressor(dict_data=_codec_dictionary(dictionary))

    def entry(self, i: int) -> tuple[int | None, int, int, int]:
        """doc_id, tokens, and the frame's place in the block."""
        doc_id, null, n, end = ENTRY.unpack_from(self.raw, HEADER.size + ENTRY.size * i)
        begin = ENTRY.unpack_from(self.raw, HEADER.size + ENTRY.size * (i - 1))[3] if i else 0
        return None if null else doc_id, n, self.start + begin, self.start + end

    def ids32(self, i: int) -> bytes:
        """Ids of the i-th document as little-endian uint32 bytes."""
        _, n, begin, end = self.entry(i)
        return _deserialize(self.decompressor.decompress(self.raw[begin:end], max_output_size=n * self.width), self.width)


def write_store(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, level: int = 3, **dictionary) -> None:
    """Write ``docs`` (doc_id, text, ...) as a token store at ``path``.

    Texts are encoded and compressed where they are read; one shuffle then
    carries the compressed frames to ranges of ``doc_id``. The ranges come from
    approximate quantiles of ``doc_id`` alone, as a range exchange would
    otherwise encode everything twice to sample its keys. Rows of an id that is
    several quantiles (or null) come in any order, so that they are dealt over
    as many buckets by their frames.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows, named = docs.agg(F.count("*"), F.count("doc_id")).first()
    raw_dict = train_dictionary(docs, tokenizer, end_id, rows=rows, **dictionary)
    dict_hash = hashlib.sha256(raw_dict).digest()
    spark.createDataFrame([(bytearray(dict_hash), bytearray(raw_dict))], "hash binary, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")

    n = common.shuffle_partitions(spark)
    buckets = 4 * n
    quantiles = Counter(docs.stat.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.25 / buckets))
    cuts, often = sorted(quantiles), {int(v): k for v, k in quantiles.items() if k > 1} | {None: max(1, buckets * (rows - named) // max(rows, 1))}
    stride = 2 * buckets  # of a range's own buckets

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_left

        import zstandard

        encoder = IdEncoder.shared(tokenizer)
        codec = _codec_dictionary(raw_dict)
        compress = zstandard.ZstdCompressor(level=level, dict_data=codec, write_checksum=False).compress
        for batch in batches:
            ids, frames, counts = batch.column(0), [], []
            for found in encoder(x.as_buffer().to_pybytes() for x in batch.column(1)):
                counts.append(len(found) + 1)
                frames.append(compress(_serialize(found, end_id, encoder.width)))
            places = []
            for x, frame in zip(ids.to_pylist(), frames, strict=True):
                first = 0 if x is None else (bisect_left(cuts, x) + 1) * stride
                places.append(first + (1 + zlib.crc32(frame) % often[x] if x in often else 0))
            yield pa.record_batch([pa.array(places, pa.int32()), ids, pa.array(counts, pa.int32()), pa.array(frames, pa.binary())], names=["bucket", "doc_id", "n_tokens", "frame"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "seq", "first_id", "last_id", "n_docs", "n_tokens", "tokens_before", "block"]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        width = IdEncoder.shared(tokenizer).width
        now, seq, before, held, entries = None, 0, 0, 0, []

        def flush() -> pa.RecordBatch:
            tokens = sum(e[1] for e in entries)
            row = (now, seq, entries[0][0], entries[-1][0], len(entries), tokens, before, write_block(entries, width, end_id, dict_hash))
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            for bucket, doc_id, count, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if entries and (bucket != now or held >= BLOCK_BYTES):
                    yield flush()
                    before += sum(e[1] for e in entries)
                    seq, held, entries = seq + 1, 0, []
                if bucket != now:
                    now, seq, before = bucket, 0, 0
                entries.append((doc_id, count, frame))
                held += len(frame)
        if entries:
            yield flush()

    frames = docs.mapInArrow(encode, "bucket int, doc_id long, n_tokens int, frame binary")
    ordered = frames.repartition(n, "bucket").sortWithinPartitions("bucket", "doc_id", "n_tokens", "frame")
    ordered.mapInArrow(pack, "bucket int, seq int, first_id long, last_id long, n_docs int, n_tokens long, tokens_before long, block binary").write.option("compression", "none").parquet(f"{path}/blocks")


def _open(spark: SparkSession, path: str) -> tuple[DataFrame, bytes, dict[int, int]]:
    """Blocks, the dictionary, and the tokens before each bucket (as many entries as buckets)."""
    raw = bytes(spark.read.parquet(f"{path}/dictionary").first()["bytes"])
    blocks = spark.read.parquet(f"{path}/blocks")
    before, total = {}, 0
    for r in sorted(blocks.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect()):
        before[r.bucket], total = total, total + r.n
    return blocks, raw, before


def _each(batches: Iterator[pa.RecordBatch], raw: bytes, before: dict[int, int], make) -> Iterator[list[tuple]]:
    for batch in batches:
        for bucket, ahead, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            block, start = Block(data, raw), before[bucket] + ahead
            rows = []
            for i in range(block.n_docs):
                doc_id, n, *_ = block.entry(i)
                rows.append(make(doc_id, start, n, block.ids32(i)))
                start += n
                if len(rows) == 2000:
                    yield rows
                    rows = []
            if rows:
                yield rows


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens, ids of every stored document."""
    blocks, raw, before = _open(spark, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _each(batches, raw, before, lambda d, s, n, ids: (d, s, n, np.frombuffer(ids, "<u4"))):
            d, s, n, ids = zip(*rows, strict=True)
            yield pa.record_batch([pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.select("bucket", "tokens_before", "block").mapInArrow(read, "doc_id long, start long, n_tokens long, ids array<long>")


def store_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every stored document, computed where the blocks are read."""
    blocks, raw, before = _open(spark, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _each(batches, raw, before, lambda d, s, n, ids: (d, s, n, zlib.crc32(ids))):
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("bucket", "tokens_before", "block").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as a token store in the shared folder and read their digests back."""
    path = common.shared_path(spark, "token-store")
    write_store(common.documents(spark, sf_dir), path)
    return store_digests(spark, path)
