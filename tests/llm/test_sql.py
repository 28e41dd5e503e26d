"""Queries of the corpus operators against their SQL in an independent database."""

import duckdb
import pytest
from llm_tables import EDGES

from driftgauge.llm import registry
from test_corpus import SECRETS, corpus, leaky_text

SF = "/root/testdata/sf0.001"


def same(spark, name, folder, files):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{files}'")
    df, want = registry.queries()[name](spark, folder), con.sql(registry.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    rows = lambda cols, found: sorted((tuple(r[cols.index(c)] for c in names) for r in found), key=repr)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    same(spark, name, SF, f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", ["quality_statistics", "secret_base_spans", "op4_ngram_jaccard_join", "op6_chunk_dedup"])
def test_same_rows_on_edges(spark, docs_dir, name):
    import random

    rnd = random.Random(3)
    # not the very long text: lists cut in SQL cost its length squared
    rows = [r for r in EDGES if r[0] is not None and len(r[1] or "") < 10_000] + [(1000 + i, *r[1:]) for i, r in enumerate(SECRETS[len(EDGES) :])] + [(100 + i, t) for i, t, *_ in corpus(60)] + [(2000 + i, leaky_text(rnd, 12)) for i in range(30)]
    if name in ("op4_ngram_jaccard_join", "op6_chunk_dedup"):
        rows = list(dict.fromkeys(rows))
    folder = docs_dir(rows)
    same(spark, name, folder, f"{folder}/documents.parquet/*.parquet")
