"""Materialized views: a query's result as a table that is refreshed as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from driftgauge.store import shared_folder


class MaterializedView:
    """The rows of a query as of its last refresh. Each refresh writes a new snapshot; readers of the old one keep it."""

    def __init__(self, spark: SparkSession, query: str, folder: str | None = None):
        self.spark, self.query = spark, query
        self.folder = folder or f"{shared_folder(spark)}/driftgauge-view-{uuid.uuid4().hex[:12]}"
        self.version = 0

    def refresh(self, with_data: bool = True) -> None:
        df = self.spark.sql(self.query)
        (df if with_data else df.limit(0)).write.parquet(f"{self.folder}/v{self.version + 1}")
        self.version += 1

    def read(self) -> DataFrame:
        if not self.version:
            raise ValueError("the view has not been populated; refresh it first")
        return self.spark.read.parquet(f"{self.folder}/v{self.version}")
