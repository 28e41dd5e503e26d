import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from driftgauge.llm import bpe, token_store, units, viterbi_counts
from llm_tables import EDGES, table

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ALPHABET = st.text(st.sampled_from(" \n\t\x0b  a1'.é日🙂sXtre<|>_"), max_size=40)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(ALPHABET)
def test_segment_tree_equals_library(text):
    ours = bpe.SegmentTreeBpe.shared("byte_bpe_50k.json")
    ids = ids_of(text)
    assert ours.encode(text) == ids
    assert ours.decode(ids) == TOKENIZER.decode(ids, skip_special_tokens=False)
    n, sha, decoded = next(ours.digests([text.encode()]))
    assert (n, sha) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert decoded == hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.lists(ALPHABET, max_size=12))
def test_pieces_equal_whole_texts(texts):
    encoder = token_store.IdEncoder.shared("byte_bpe_50k.json")
    assert [g.tolist() for g in encoder(t.encode() for t in texts)] == [ids_of(t) for t in texts]


def test_piece_table_starts_anew_and_survives_collisions(monkeypatch):
    encode = lambda ts: [ids_of(t) for t in ts]
    small = units.PieceTable(encode, limit=3)
    texts = ["a b c", "d e f", "a b c d e f g"]
    for _ in range(3):
        assert [g.tolist() for g in units.encode_texts([t.encode() for t in texts], small, ids_of, [])] == [ids_of(t) for t in texts]
    real = units.piece_hashes
    monkeypatch.setattr(units, "piece_hashes", lambda d, s, e: real(d, s, e) % 2)
    clash = units.PieceTable(encode)
    for _ in range(2):
        assert [g.tolist() for g in units.encode_texts([t.encode() for t in texts], clash, ids_of, [])] == [ids_of(t) for t in texts]


def test_pieces_of_one_hash_are_told_apart():
    """Thue-Morse words and their complements share every polynomial hash modulo 2^64 with an odd multiplier."""
    for n in (10, 11, 12):
        bits = [bin(i).count("1") % 2 for i in range(1 << n)]
        pair = ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]
        starts = np.array([0, 1 << n])
        hashes = units.piece_hashes(np.frombuffer("".join(pair).encode(), np.uint8), starts, starts + (1 << n))
        assert hashes[0] == hashes[1]
        want = [ids_of(t) for t in pair]
        for both, order in ((pair, want), (pair[::-1], want[::-1])):
            raw = [t.encode() for t in both]
            for encoder in (token_store.IdEncoder("byte_bpe_50k.json"), bpe.SegmentTreeBpe("byte_bpe_50k.json").ids):
                assert [g.tolist() for g in encoder(raw)] == order
                assert [g.tolist() for x in raw for g in encoder([x])] == order


def test_full_table_keeps_what_comes_back():
    calls = []
    table_ = units.PieceTable(lambda ts: [calls.append(t) or ids_of(t) for t in ts], limit=40)
    texts = [" ".join(["often", "again", *(f"once{i}x{j}" for j in range(9))]) for i in range(30)]
    for t in texts:
        assert [g.tolist() for g in units.encode_texts([t.encode()], table_, ids_of, [])] == [ids_of(t)]
        assert len(table_.keys) <= 40 + 11
    assert calls.count(" again") == 1 and calls.count("often") == 1 and len(calls) == 2 + 30 * 9


def test_blocks_of_pieces(monkeypatch):
    monkeypatch.setattr(units.PieceTable, "BLOCK", 16)
    table_ = units.PieceTable(lambda ts: [ids_of(t) for t in ts], byte_limit=64)
    texts = ["some words " * 20, "x", "", "averyveryverylongwordwithoutanyspaces in the middle", "some other words"]
    for _ in range(2):
        assert [g.tolist() for g in units.encode_texts([t.encode() for t in texts], table_, ids_of, [])] == [ids_of(t) for t in texts]


def test_special_text_and_long_words():
    ours = bpe.SegmentTreeBpe.shared("byte_bpe_50k.json")
    for text in ("x<|endoftext|> y", "ab" * 3000, "é" * 500):
        assert ours.encode(text) == ids_of(text)
    assert ours.decode([50256, 220]) == "<|endoftext|> "


def test_bpe_columns(spark):
    df = table(spark, EDGES)
    back = bpe.decode_column(bpe.encode_column(df)).select("text", "ids", "decoded").collect()
    for text, ids, decoded in back:
        assert ids == ids_of(text) and decoded == (text or "")


def test_bpe_query(spark, docs_dir):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.op5_bpe_round_trip(spark, docs_dir(EDGES)).collect()}
    assert got == {(d, len(ids_of(t)), hashlib.sha256(",".join(map(str, ids_of(t))).encode()).hexdigest()) for d, t in EDGES}


def test_token_store_query(spark, docs_dir):
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.op1_token_store(spark, docs_dir(EDGES)).collect())
    start, expected = 0, []
    for d, t in sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(t) + [2]
        expected.append((start, d, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert got == expected


def test_store_round_trip_and_random_access(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["the", "cat", "sat", "ünder", "mats"]) for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    path = str(tmp_path / "store")
    token_store.write_store(table(spark, rows), path)
    stored = {r.doc_id: r.ids for r in token_store.read_store(spark, path).collect()}
    assert stored == {d: ids_of(t) + [2] for d, t in rows}
    raw = bytes(spark.read.parquet(f"{path}/dictionary").first()["bytes"])
    row = spark.read.parquet(f"{path}/blocks").first()
    block = token_store.Block(bytes(row.block), raw)
    doc, n, *_ = block.entry(block.n_docs - 1)
    assert struct.unpack(f"<{n}I", block.ids32(block.n_docs - 1)) == tuple(stored[doc])
    with pytest.raises(ValueError):
        token_store.Block(bytes(row.block), raw + b"x")
    with pytest.raises(ValueError):
        token_store.Block(b"????" + bytes(row.block)[4:], raw)


def test_empty_tables(spark, docs_dir):
    d = docs_dir([])
    assert token_store.op1_token_store(spark, d).count() == 0
    assert bpe.op5_bpe_round_trip(spark, d).count() == 0
    assert viterbi_counts.op9_token_counts(spark, d).count() == 0


def unigram(vocabulary, fallback):
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=fallback))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(prepend_scheme="always")])
    return t


TIES = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("▁a", -2.0), ("s", -1.5), ("tr", -1.25), ("<|>", -2.0)]
BIG = viterbi_counts.zipf_vocabulary()
MODELS = {"ties": (viterbi_counts.CountOnlyViterbi(TIES, False), unigram(TIES, False)), "large": (viterbi_counts.CountOnlyViterbi(BIG), unigram(BIG, True))}


@pytest.mark.parametrize("name", MODELS)
@settings(max_examples=200, deadline=None)
@given(st.one_of(ALPHABET, st.text("ab s", max_size=30), st.text(max_size=20)))
def test_counts_equal_library(name, text):
    ours, library = MODELS[name]
    assert ours.text(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_count_query(spark, docs_dir):
    library = MODELS["large"][1]
    got = sorted(((r.doc_id or 0), r.n_tokens) for r in viterbi_counts.op9_token_counts(spark, docs_dir(EDGES)).collect())
    assert got == sorted(((d or 0), len(library.encode(t or "").ids)) for d, t in EDGES)


def test_rows_of_one_id_are_dealt_over_buckets(spark, tmp_path):
    rows = [(None, f"text {i}") for i in range(150)] + [(70, f"other {i}") for i in range(150)] + [(i, f"own {i}") for i in range(100)]
    path = str(tmp_path / "store")
    token_store.write_store(table(spark, rows), path)
    blocks = spark.read.parquet(f"{path}/blocks").collect()
    assert len({b.bucket for b in blocks if b.last_id is None}) > 2 and len({b.bucket for b in blocks if b.first_id == b.last_id == 70}) > 2
    found = token_store.read_store(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in found if r.doc_id is not None] == sorted(d for d, _ in rows if d is not None) and [r.doc_id for r in found[:150]] == [None] * 150
    assert sorted((r.doc_id or -1, list(r.ids)) for r in found) == sorted((d or -1, [*ids_of(t), 2]) for d, t in rows)
    at = 0
    for r in found:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
