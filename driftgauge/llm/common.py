"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a regular-expression class body, and as characters.
WS = r"\x20\x09-\x0D"
SPACES = " \t\n\v\f\r"


def ship(spark: SparkSession) -> None:
    """Put this package's folder on the workers' path, for sessions that were started elsewhere.

    On a cluster the package is installed or sent along as usual; the extra
    entry does no harm there.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, root])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as make it new to the table."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (local tests) a temporary folder is
    made and set.
    """
    jsc = spark.sparkContext._jsc.sc()
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder and jsc.getCheckpointDir().isDefined():
        folder = jsc.getCheckpointDir().get()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="driftgauge-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = jsc.getCheckpointDir().get()
    return folder.rstrip("/")


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; what is written there is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/driftgauge-{name}-{uuid.uuid4().hex[:12]}"

    def drop() -> None:
        try:
            remove_path(spark, path)
        except Exception:  # the session has ended
            if path.startswith("file:"):
                import shutil

                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)

    atexit.register(drop)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    A lost executor then costs a re-read of files, not a recomputation.
    """
    spark = df.sparkSession
    ship(spark)
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted(rows: DataFrame, row_id: str) -> DataFrame:
    """``rows``, written, with ``__salt``: 0 where the id names one row, else a number of the row's own.

    Null and repeated ids may name any share of the rows; whoever deals rows by
    id deals by both, so that such rows spread and all others go where their id says.
    """
    rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "salted")
    many = materialize(rows.where(F.col(row_id).isNotNull()).groupBy(F.col(row_id).alias("__many")).agg(F.count("*").alias("k")).where("k > 1").drop("k"), "repeated-ids")
    joined = rows.join(many, F.col(row_id) == F.col("__many"), "left")
    return joined.withColumn("__salt", F.when(F.col(row_id).isNull() | F.col("__many").isNotNull(), F.col("__row") + 1).otherwise(0)).drop("__row", "__many")


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` wrote, once all that needed them is written."""
    files = df.inputFiles()
    if files:
        remove_path(df.sparkSession, files[0].rpartition("/")[0])


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that nothing refers to any more.

    It does so when the driver collects its garbage, which a quiet driver may
    not do for long; after a large exchange whose result is written, that is
    disk held for nothing.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_below(share: float) -> int:
    """The 64-bit value that a signed 64-bit hash does not exceed with the given chance."""
    return min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))


def tokenizer_path(name_or_path: str) -> str:
    """A vocabulary file: a path is taken as it is, a bare name is looked up where the code runs."""
    if os.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return str(public_tokenizers.path(name_or_path))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(items: Column, kind: str, zero: Column, step: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """The state of a fold after each item of an array.

    Folded in blocks, as an array is copied whenever something is appended: the
    work is ``block`` copies an item, and a copy of what blocks there are a block.
    """

    def over(a: Column) -> Column:
        def fold(acc: Column, b: Column) -> Column:
            start = F.struct(acc["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
            inner = F.aggregate(F.slice(a, b * block + 1, F.lit(block)), start, lambda s, x: F.struct(step(s["at"], x).alias("at"), F.array_append(s["out"], step(s["at"], x)).alias("out")))
            return let(inner, lambda r: F.struct(r["at"].alias("at"), F.array_append(acc["out"], r["out"]).alias("out")))

        start = F.struct(zero.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(a) / block).cast("int")), start, fold, lambda acc: F.flatten(acc["out"]))

    return let(items, over)


class BoundedCache(dict):
    """A dict that empties itself when ``put`` finds it full, so that its memory has a bound.

    Frequent keys come back at once; rare ones, most of any such cache, are
    what the emptying gets rid of.
    """

    #: Longer keys are not kept, so that a number of keys bounds the bytes too.
    LONGEST = 128

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def put(self, key: str | bytes, value) -> None:
        if len(key) > self.LONGEST:
            return
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
