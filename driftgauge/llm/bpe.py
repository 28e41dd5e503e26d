"""Byte-level BPE encoding and decoding with a segment tree over pair ranks.

A pre-token starts as its bytes. The leaves of a segment tree hold the merge
rank of every adjacent pair together with its place; the root is then the
leftmost pair of the lowest rank. A merge changes three leaves, each a walk of
logarithmic length, and the work ends when the root holds no rank. A pre-token
of n bytes takes O(n log n) steps, however long it is.

Null text counts as empty: no ids, empty decoded text. Texts are never cut. Rows
with a null id and repeated rows each give their row; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.llm import common, units

_NONE = 1 << 62
_PLACE = (1 << 32) - 1


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class SegmentTreeBpe:
    """Encoder and decoder for a ``tokenizer.json`` of the byte-level BPE kind."""

    CACHE = 1_100_000
    #: Bytes of text that are encoded together.
    CALL_BYTES = 3 << 19
    _made: dict = {}

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(common.tokenizer_path(path), encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.byte_id = [0] * 256
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        self.rank: dict[int, tuple[int, int]] = {}  # pair -> (rank, merged id)
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[a] << 32 | vocab[b], (r, vocab[a + b]))
        self.piece = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.piece |= {i: t.encode() for t, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.merged_id = {r: m for r, m in self.rank.values()}
        self.pretokens = common.BoundedCache(self.CACHE)
        self.table = units.PieceTable(lambda texts: [self._plain(t) for t in texts])
        self.decimal = [str(i) for i in range(max(self.piece) + 1)]

    @classmethod
    def shared(cls, path: str) -> SegmentTreeBpe:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.byte_id[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        rank, none = self.rank, _NONE
        leaves = n - 1
        size = 1 << (leaves - 1).bit_length() if leaves > 1 else 1
        tree = [none] * (2 * size)
        for i in range(leaves):
            found = rank.get(ids[i] << 32 | ids[i + 1])
            if found:
                tree[size + i] = found[0] << 32 | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                a, b = tree[i], tree[i ^ 1]
                i >>= 1
                best = a if a < b else b
                if tree[i] == best:
                    return
                tree[i] = best

        while (root := tree[1]) < none:
            i = root & _PLACE
            j = after[i]
            ids[i] = here = self.merged_id[root >> 32]
            ids[j] = -1
            k = after[i] = after[j]
            if j < leaves:
                put(j, none)
            found = None
            if k < n:
                before[k] = i
                found = rank.get(here << 32 | ids[k])
            put(i, found[0] << 32 | i if found else none)
            p = before[i]
            if p >= 0:
                found = rank.get(ids[p] << 32 | here)
                put(p, found[0] << 32 | p if found else none)
        return [x for x in ids if x >= 0]

    def _pretoken(self, word: str) -> list[int]:
        ids = self.pretokens.get(word)
        if ids is None:
            ids = self.merge(word.encode())
            self.pretokens.put(word, ids)
        return ids

    def _plain(self, text: str) -> list[int]:
        return [i for word in self.pattern.findall(text) for i in self._pretoken(word)]

    def encode(self, text: str) -> list[int]:
        """Ids of a text; strings of special tokens in it become those tokens, as the library does by default."""
        if not self.split_special:
            return self._plain(text)
        out: list[int] = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self._plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        piece = self.piece
        return b"".join([piece[i] for i in ids]).decode("utf-8", "replace")

    def ids(self, texts: Iterable[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text (UTF-8), in calls of bounded size; pieces that encode independently are encoded once."""
        held, size = [], 0
        special = [t.encode() for t in self.special]
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= self.CALL_BYTES:
                yield from units.encode_texts(held, self.table, self.encode, special)
                held, size = [], 0
        if held:
            yield from units.encode_texts(held, self.table, self.encode, special)

    def digests(self, texts: Iterable[bytes]) -> Iterator[tuple[int, str, str]]:
        """Tokens, sha256 of the decimal ids, sha256 of the decoded text, of each text (UTF-8)."""
        decimal = self.decimal
        for ids in map(np.ndarray.tolist, self.ids(texts)):
            written = ",".join([decimal[i] for i in ids]).encode()
            yield len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()


def encode_column(df: DataFrame, text: str = "text", out: str = "ids", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """``df`` with a column of token ids of ``text`` (null: empty)."""
    schema = df.drop(out).schema
    keep = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = SegmentTreeBpe.shared(tokenizer)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(k)) for k in keep), pa.array(ids, pa.list_(pa.int32()))], names=[*keep, out])

    from pyspark.sql import types as T

    return df.drop(out).mapInArrow(run, T.StructType([*schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode_column(df: DataFrame, ids: str = "ids", out: str = "decoded", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """``df`` with the text of a column of token ids (null: empty)."""
    schema = df.drop(out).schema
    keep = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = SegmentTreeBpe.shared(tokenizer)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(k)) for k in keep), pa.array(texts, pa.string())], names=[*keep, out])

    from pyspark.sql import types as T

    return df.drop(out).mapInArrow(run, T.StructType([*schema.fields, T.StructField(out, T.StringType())]))


def round_trip_digests(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; a map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = SegmentTreeBpe.shared(tokenizer)
        for batch in batches:
            rows = list(bpe.digests(t.as_buffer().to_pybytes() for t in batch.column(1)))
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of ``documents``."""
    return round_trip_digests(common.documents(spark, sf_dir))
