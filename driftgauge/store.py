"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the session has it; a temporary folder, set as such, in local tests."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="driftgauge-")
        atexit.register(shutil.rmtree, made, True)
        context.setCheckpointDir(f"file://{made}")
        folder = context._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def remove_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_folder(spark)}/driftgauge-{name}-{uuid.uuid4().hex[:12]}"

    def drop() -> None:
        try:
            remove_path(spark, path)
        except Exception:  # the session has ended before the driver
            if path.startswith("file:"):
                shutil.rmtree(re.sub("^file:/*", "/", path), ignore_errors=True)

    atexit.register(drop)
    return path


def write_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back, so that a lost executor costs a read."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
