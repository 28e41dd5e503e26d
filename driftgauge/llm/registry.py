"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftgauge.llm import laws
from driftgauge.llm.bpe import op5_bpe_round_trip
from driftgauge.llm.chunk_dedup import OP6_SQL, op6_chunk_dedup
from driftgauge.llm.language import op7_language_crf, op7_language_spans
from driftgauge.llm.ngram_join import OP4_SQL, op4_ngram_jaccard_join
from driftgauge.llm.packing import op8_best_fit_packing
from driftgauge.llm.quality import op3_quality_rules
from driftgauge.llm.secrets import op10_secret_scan
from driftgauge.llm.shards import op2_histogram_shards
from driftgauge.llm.token_store import op1_token_store
from driftgauge.llm.viterbi_counts import op9_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f.__name__: f for f in (op1_token_store, op2_histogram_shards, op3_quality_rules, op4_ngram_jaccard_join, op5_bpe_round_trip, op6_chunk_dedup, op7_language_crf, op7_language_spans, op8_best_fit_packing, op9_token_counts, op10_secret_scan)}
    return found | laws.QUERIES


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_jaccard_join": OP4_SQL, "op6_chunk_dedup": OP6_SQL} | laws.ORACLES
