"""The pipeline's stages and their result against a version in plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from driftgauge.llm import packing, quality
from llm_tables import EDGES, LONG, table
from test_corpus import base, brute_components, brute_pack, brute_spans, leaky_text, normal

pipeline = pytest.importorskip("corpus_pipeline")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def features(text):
    n, chars, symbols, dups, repeats = base(text)
    words, body = WORDS.findall(text or ""), text or ""
    lines = [x for x in body.split("\n") if WORDS.search(x)]
    facts = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dups, "n_repeat_words": repeats, "n_bangs": body.count("!"), "n_lines": len(lines), "n_distinct_words": len(set(words))}
    ratio = {f: eval(e.replace("greatest", "max"), {"max": max}, facts) for f, e in quality.FEATURES.items()}  # noqa: S307  our own expressions
    return facts, ratio


def brute(rows, rules):
    """Rows (id, text, lang, source) that each filtering stage leaves, in Python."""
    out = {}

    def good(text):
        facts, ratio = features(text)
        return not (facts["n_words"] < quality.LEAST_WORDS or 100 * facts["n_repeat_words"] > quality.MOST_REPEATED_PERCENT * facts["n_words"]) and not any(r.holds(ratio) for r in rules)

    rows = out["quality_rules"] = [r for r in rows if good(r[1])]
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r[1])].append(r)
    rows = out["exact_dedup"] = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    nulls = [r for r in rows if r[0] is None]
    named = [r for r in rows if r[0] is not None]
    assert len({r[0] for r in named}) == len(named)
    parts = brute_components([r[:2] for r in named])
    rows = out["near_duplicates"] = nulls + [r for r in named if parts[r[0]][1] == r[0]]

    def redacted(text):
        done, at = "", 0
        for a, e in sorted((a, e) for a, _, e in brute_spans(text)):
            if a >= at:
                done += text[at:a] + "[SECRET]"
            at = max(at, e)
        return done + text[at:]

    out["secret_scan"] = [(r[0], redacted(r[1]), *r[2:]) for r in rows]
    return out


def sample(seed=6):
    rnd = random.Random(seed)
    fresh = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 6))) for _ in range(n))
    sources = lambda: rnd.choice(["src0", "src0", "src1", None])
    good = [(i, fresh(rnd.randint(60, 200)), "en", sources()) for i in range(50)]
    rows = list(good)
    rows += [(100 + i, good[i][1].replace(" ", "  ", 3), "de", sources()) for i in range(8)]  # copies
    rows += [(200 + i, good[10 + i][1].rsplit(" ", 2)[0] + " other words", "en", sources()) for i in range(8)]  # near copies
    rows += [(230 + i, good[12][1] + " tail" * (i % 3), None, "src9") for i in range(20)]  # a group of both
    rows += [(300 + i, " ".join(x + "###" for x in fresh(90).split()), "en", "src1") for i in range(30)]  # junk
    rows += [(400, "few words", "en", "src1"), (401, None, "en", None), (402, "", "en", "src0"), (403, "same again " * 60, "en", "src0")]
    rows += [(500 + i, fresh(60) + " " + leaky_text(rnd, 6).replace("\n", " ") + fresh(60), "en", sources()) for i in range(12)]
    rows += [good[3], good[3], (None, fresh(80), "en", "src0"), (None, good[5][1], "en", "src0"), (600, LONG, "en", "src2"), (601, LONG + " more", "en", "src2")]
    labels = [(i, 1, 0) for i in range(0, 50)] + [(300 + i, 0, 0) for i in range(0, 30, 2)]
    rnd.shuffle(rows)
    return rows, labels


def test_stages_equal_brute_force(spark, docs_dir):
    rows, labels = sample()
    folder = docs_dir(rows, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("__id", "__bad", "__digest", "__spans", "__stay", "__twin", "__s_id", "component_id"):  # names the stages use themselves
        docs = docs.withColumn(name, F.lit(7))
    stats = quality.text_statistics(docs.select("doc_id", "text"))
    want = brute(rows, quality.fit(stats, spark.read.parquet(f"{folder}/labels.parquet")))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert Counter((r.doc_id, r.text, r.lang, r.source) for r in docs.collect()) == Counter(want[name]), name
    assert all(r.n_chars == len(r.text) for r in docs.collect() if "[SECRET]" in r.text)


def test_run_equals_brute_force(spark, docs_dir):
    rows, labels = sample(8)
    folder = docs_dir(rows, labels)
    stats = quality.text_statistics(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    left = brute(rows, quality.fit(stats, spark.read.parquet(f"{folder}/labels.parquet")))["secret_scan"]
    found = pipeline.run(spark, folder).collect()
    units = lambda text: len((text or "").encode()) + 1
    assert Counter(d for d in {r.doc_id for r in found}) == Counter({d for d, *_ in left})
    assert sum(r.piece_units for r in found) == sum(units(t) for _, t, *_ in left)
    bins = defaultdict(list)
    for r in found:
        bins[r.pack_group, r.bin].append(r)
    sources = {d: s for d, _, _, s in left}
    for part in bins.values():
        named = [sources[d] for d in {r.doc_id for r in part} if d is not None and sources[d] is not None]
        assert len(named) == len(set(named)) and sum(r.piece_units for r in part) <= packing.CAPACITY
    for g in {r.pack_group for r in found}:  # each group, packed in the order of its rows
        ids = list(dict.fromkeys(r.doc_id for r in found if r.pack_group == g))
        if None in ids:
            continue
        facts = {d: (units(t), s, normal(t).lower() or None) for d, t, _, s in left}
        for d, pieces in zip(ids, brute_pack([facts[d] for d in ids], packing.CAPACITY), strict=True):
            assert [(r.piece, r.bin, r.bin_offset, r.piece_units) for r in found if r.doc_id == d] == pieces


def test_empty_and_odd_tables(spark, docs_dir):
    folder = docs_dir(EDGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
    for name, stage in pipeline.STAGES[:3]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert {r.text for r in out.select("text").collect()} <= {t for _, t in EDGES}, name
    assert pipeline.STAGES[3][1](spark, docs, folder).count() == len(EDGES)
    assert pipeline.STAGES[-1][1](spark, docs, folder).select("doc_id").distinct().count() == len({d for d, _ in EDGES})


def test_empty_tables_of_single_operators(spark, docs_dir):
    from driftgauge.llm import registry

    folder = docs_dir([])
    for name, query in registry.queries().items():
        if name.startswith("op"):
            assert query(spark, folder).count() == 0, name
    assert pipeline.run(spark, folder).count() == 0
    assert table(spark, []).count() == 0
