"""Tables that jobs write for themselves, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of ids that may be broadcast: 16 bytes each, so 16 MB at most; larger sides are shuffled.
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local one is made if driver and executors are one
    process, as in tests; on a cluster that is an error, as each machine would write to its own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _own(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lattica/{spark.sparkContext.applicationId}"


#: The folders of temporary() that are open, the innermost last.
_OPEN: ContextVar[tuple[str, ...]] = ContextVar("open", default=())


def save(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and a lost executor loses nothing.

    The table stays until clear(), as results that are not yet written may still read it, or, if it is not lasting, until the end of
    the temporary() around it."""
    spark = df.sparkSession
    folder = _own(spark) if lasting or not _OPEN.get() else _OPEN.get()[-1]
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables saved within go at the end, but for lasting ones. What is still wanted then must not read the others."""
    folder = f"{_own(spark)}/temporary-{uuid.uuid4().hex}"
    token = _OPEN.set((*_OPEN.get(), folder))
    try:
        yield
    finally:
        _OPEN.reset(token)
        _delete(spark, folder)


def clear(spark: SparkSession) -> bool:
    """Deletes the tables that this application has saved. Call it when its results are written."""
    return _delete(spark, _own(spark))


def _delete(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows, else df as it is. df is counted: hand in a saved table of ids."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a column of this name: the row's number from 0 in that order over all rows, without one task that holds them all.

    Rows are dealt by range and saved; only one count for each partition is summed globally. Rows equal in the whole order are told
    apart by a number, so that they do not gather in one range."""
    order = [*order, F.col("__tie")]
    numbered = df.withColumn("__tie", F.monotonically_increasing_id())
    dealt = save(numbered.repartitionByRange(partitions(df.sparkSession), *order).withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__part").orderBy(*order)
    numbered = dealt.withColumn(name, F.row_number().over(within) - 1).join(F.broadcast(counts), "__part")
    return numbered.withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before", "__tie")
