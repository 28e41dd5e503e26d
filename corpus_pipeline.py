"""Corpus pipeline: quality rules, exact dedup, near-duplicate join, secret scan, packing.

Every stage but the last takes and returns rows with the columns of
``documents``, and any others the table has, whatever their names; the last
returns the packing plan. ``run`` applies them in order, each result written as
Parquet in the shared folder and read again.

Null and empty texts have no words, so that the first stage rejects them; a
later stage that is given them keeps them. Rows with a null id are judged and
scanned by their text, lose against a copy that has an id, and link with nothing.
Of rows repeated as they are, one stays after ``exact_dedup``. An empty table gives
an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.llm import chunk_dedup, common, ngram_join, packing, quality, secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list rejects."""
    body = F.coalesce(F.col("text"), F.lit(""))
    stats = quality.text_statistics(docs.select("doc_id", body.alias("text"), F.xxhash64(body).alias("__digest")))
    stats = common.materialize(stats, "quality-statistics")
    rules = quality.fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bad_id, bad = common.fresh(docs, "__id", "__bad")
    rejected = quality.judge(stats, rules).where("not kept").select(F.col("doc_id").alias(bad_id), F.col("__digest").alias(bad))
    return docs.join(rejected, F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.xxhash64(body) == F.col(bad)), "left_anti")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts, that of the smallest id."""
    return chunk_dedup.drop_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram join, that of the smallest id."""
    found = ngram_join.join_components(docs)
    (extra_id,) = common.fresh(docs, "__extra")
    extra = found.where("doc_id <> component_id").select(F.col("doc_id").alias(extra_id))
    return docs.join(extra, docs.doc_id == F.col(extra_id), "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; n_chars follows the text."""
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.when(F.contains("text", F.lit("[SECRET]")), F.length("text").cast(kind)).otherwise(F.col("n_chars")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 32768 bytes without two documents of a source or of a group of copies."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Learned rules and the packing are beyond SQL; tests/llm/test_pipeline.py holds every stage and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
