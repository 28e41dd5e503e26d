"""The test tables with the derived columns the workload uses."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: Columns that make a row of lineitem unique.
LINEITEM_ID = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
#: Julian day of 1970-01-01.
JULIAN_EPOCH = 2_440_588


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def version(spark: SparkSession, sf_dir: str, name: str) -> tuple[int, int, int]:
    """Files, bytes and last change of a table, by which an index of an older state is known."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = list(fs.listStatus(path))
    return len(found), sum(f.getLen() for f in found), max((f.getModificationTime() for f in found), default=0)


def julian(day) -> F.Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date")) + JULIAN_EPOCH


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with the ship date's Julian day."""
    return load(spark, sf_dir, "lineitem").withColumn("shipdate_julian", julian(F.col("l_shipdate").cast("date")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with the Julian day of the time stamp."""
    return load(spark, sf_dir, "events").withColumn("julian_date", julian(F.col("ts").cast("date")))


def register_views(spark: SparkSession, sf_dir: str, text: str | None = None) -> None:
    """Temporary views of the tables, each named as its table; only of those that a text names, if it is given."""
    for name in NAMES if text is None else [n for n in NAMES if re.search(rf"\b{n}\b", text)]:
        load(spark, sf_dir, name).createOrReplaceTempView(name)
