"""What SQL can say about operators that are not SQL as a whole.

Each query takes its rows from an operator and returns what an independent
database can compute: base statistics and base spans in full, and for layouts
(shards, bins) whether their laws hold, beside totals of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.llm import packing, quality, secrets, shards

_WORD = r"[^\x20\x09-\x0D]"


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and base verdict of every document."""
    return quality.op3_quality_rules(spark, sf_dir).drop("kept")


QUALITY_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT rid, doc_id, body, regexp_extract_all(body, '{_WORD}+') AS w, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
t AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS three FROM w),
f AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, three) AS c FROM t),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM f, (VALUES (0), (1), (2)) v(k) WHERE c > 1 GROUP BY rid),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(body) - length(regexp_replace(body, '[{quality.SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM w LEFT JOIN r USING (rid))
SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED_PERCENT} * n_words AS base_failed FROM s"""


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base findings of every document."""
    return secrets.op10_secret_scan(spark, sf_dir).drop("spans")


def _base_sql() -> str:
    parts = []
    for kind, (pattern, group, least) in enumerate(((secrets.ASSIGN, 2, secrets.ASSIGN_LEAST), (secrets.ACCESS, 0, secrets.ACCESS_LEAST), ("[0-9a-f]+", 0, 32))):
        p = pattern.replace("'", "''")
        found = f"SELECT rid, regexp_extract_all(body, '{p}') AS m, regexp_extract_all(body, '{p}', {group}) AS g, regexp_split_to_array(body, '{p}') AS gaps FROM d WHERE regexp_matches(body, '{p}')"
        each = f"SELECT rid, unnest(range(len(m))) AS i, unnest(m) AS m, unnest(g) AS g, unnest(gaps[1:len(m)]) AS gap FROM ({found})"
        placed = f"SELECT rid, sum(length(gap) + length(m)) OVER (PARTITION BY rid ORDER BY i) AS e, length(m) AS n, length(g) AS size FROM ({each})"
        parts.append(f"SELECT rid, {kind} AS kind, CAST(e - n AS BIGINT) AS a, CAST(e AS BIGINT) AS e FROM ({placed}) WHERE size >= {least}")
    names = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS[:3]) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
s AS ({' UNION ALL '.join(parts)}),
t AS (SELECT rid, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, string_agg(({names})[kind + 1] || ':' || a || ':' || e, ',' ORDER BY a, kind) AS listed FROM s GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(listed, '')) AS base_sha256 FROM d LEFT JOIN t USING (rid)"""


SECRET_SQL = _base_sql()


def shard_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the shards, and whether bytes are balanced within the tolerance (and two largest rows) and slots have no gap."""
    rows = shards.op2_histogram_shards(spark, sf_dir)
    per = rows.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.max("size").alias("most"), F.min("slot").alias("first"), F.max("slot").alias("last"), F.count_distinct("slot").alias("slots"))
    whole = per.agg(F.sum("n").alias("n_docs"), F.sum("b").alias("bytes"), F.max("b").alias("high"), F.min("b").alias("low"), F.max("most").alias("most"), F.count("*").alias("k"), F.bool_and(F.expr("first = 0 and last = n - 1 and slots = n")).alias("gapless"))
    share = F.col("bytes") / 16
    slack = 2 * 0.002 * share + 2 * F.col("most")
    return whole.select("n_docs", "bytes", "gapless", ((F.col("high") <= share + slack) & ((F.col("low") >= share - slack) | (F.col("k") < 16))).alias("balanced"))


SHARD_SQL = "SELECT count(*) AS n_docs, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes, true AS gapless, true AS balanced FROM documents"


def packing_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the bins, and whether every piece is there once, bins hold no more than they can, and no source meets itself."""
    rows = packing.op8_best_fit_packing(spark, sf_dir)
    sources = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source").distinct()
    bins = rows.groupBy("pack_group", "bin").agg(F.sum("piece_units").alias("units"), F.max(F.col("bin_offset") + F.col("piece_units")).alias("end"))
    full = bins.agg(F.bool_and(F.expr(f"units <= {packing.CAPACITY} and `end` = units")).alias("fits"))
    meets = rows.join(sources, "doc_id").where("source is not null").select("pack_group", "bin", "source", "doc_id").distinct().groupBy("pack_group", "bin", "source").count()
    apart = meets.agg(F.coalesce(F.max("count") <= 1, F.lit(True)).alias("apart"))
    docs = rows.groupBy("doc_id").agg(F.sum("piece_units").alias("units"))
    whole = docs.agg(F.count("*").alias("n_docs"), F.sum("units").alias("units"))
    return whole.join(F.broadcast(full)).join(F.broadcast(apart))  # one row each


PACKING_SQL = "SELECT count(DISTINCT doc_id) AS n_docs, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS units, true AS fits, true AS apart FROM documents WHERE doc_id IS NOT NULL"

QUERIES = {f.__name__: f for f in (quality_statistics, secret_base_spans, shard_laws, packing_laws)}
ORACLES = {"quality_statistics": QUALITY_SQL, "secret_base_spans": SECRET_SQL, "shard_laws": SHARD_SQL, "packing_laws": PACKING_SQL}
