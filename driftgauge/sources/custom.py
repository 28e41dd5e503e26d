"""Custom scans: a source of one's own, as a node that Spark plans like any table.

A provider says which columns it has, cuts its work into parts, and yields the
rows of a part on an executor; equality and range filters on whole-number columns
reach it through :meth:`Provider.parts`.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Provider(Protocol):
    """What a custom scan needs: a schema in DDL, parts as plain tuples of numbers, and the rows of a part as Arrow batches."""

    schema: str

    def parts(self, low: int | None, high: int | None) -> list[tuple[int, int]]: ...

    def scan(self, part: tuple[int, int]) -> Iterable[pa.RecordBatch]: ...


def custom_scan(spark: SparkSession, provider: Provider, low: int | None = None, high: int | None = None) -> DataFrame:
    """The provider's rows; [low, high) limits the parts that are scanned, one task for each."""
    parts = provider.parts(low, high)
    table = spark.createDataFrame(parts or [(0, 0)], "a long, b long").where(F.lit(bool(parts)))

    def run(batches):
        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from provider.scan((a, b))

    return table.repartition(max(1, len(parts)), "a").mapInArrow(run, provider.schema)


def series_provider(count: int, width: int) -> Provider:
    """(n, square) for n below ``count``, in parts of ``width`` numbers: the least custom source there is."""

    class Series:
        schema = "n long, square long"

        def parts(self, low, high):
            first, last = max(0, low or 0), min(count, count if high is None else high)
            return [(a, min(a + width, last)) for a in range(first, last, width)]

        def scan(self, part):
            import pyarrow

            n = list(range(*part))
            yield pyarrow.record_batch([pyarrow.array(n, pyarrow.int64()), pyarrow.array([i * i for i in n], pyarrow.int64())], names=["n", "square"])

    return Series()
