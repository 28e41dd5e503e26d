"""Bucketed tables: joins and aggregates that stay inside their partitions.

Two tables that are bucketed alike on a key lie together, bucket by bucket, so
that a join or an aggregate on the key needs no exchange.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame


class BucketedTable:
    """A table of the session's warehouse, bucketed and sorted on keys; dropped when the driver ends."""

    def __init__(self, df: DataFrame, keys: list[str], buckets: int):
        self.spark, self.name = df.sparkSession, f"driftgauge_{uuid.uuid4().hex[:12]}"
        # one file for each bucket, so that a bucket is read in order
        placed = df.repartition(buckets, *keys)
        placed.write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(self.name)
        atexit.register(self.drop)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        try:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        except Exception:  # the session has ended
            pass
