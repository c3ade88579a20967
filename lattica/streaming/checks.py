"""Constraints on streams. What validate() adds is stateless, so it is the same on a stream; what follows adds counts and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans.constraints import Constraint, validate


def read(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """A folder of parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _timed(stream: DataFrame, time: str) -> DataFrame:
    """Watermarks need a timestamp with a zone; one without is read in the session's."""
    return stream.withColumn(time, F.col(time).cast("timestamp")) if isinstance(stream.schema[time].dataType, T.TimestampNTZType) else stream


def violation_counts(stream: DataFrame, schema: Constraint, time: str, window: str = "10 minutes", late: str | None = "30 minutes", slide: str | None = None) -> DataFrame:
    """Rows and invalid rows for each window of event time; rows later than `late` behind the newest are left out, so state is bounded.

    late is None where the stream has a watermark already. With slide, windows begin that often and a row is in each that holds it."""
    checked = _timed(validate(stream, schema), time)
    checked = checked.withWatermark(time, late) if late else checked
    return checked.groupBy(F.window(time, window, slide)).agg(*_counts())


def session_counts(stream: DataFrame, schema: Constraint, time: str, by: list[str], gap: str = "10 minutes", late: str | None = "30 minutes") -> DataFrame:
    """The same counts for each key's sessions: runs of rows less than `gap` apart. A null key is a key; rows without a time are left out."""
    checked = _timed(validate(stream, schema), time)
    checked = checked.withWatermark(time, late) if late else checked
    return checked.groupBy(*by, F.session_window(time, gap).alias("session")).agg(*_counts())


def _counts() -> list[Column]:
    return [F.count("*").alias("n"), F.count_if(F.size("violations") > 0).alias("n_invalid")]


def split_to(stream: DataFrame, schema: Constraint, good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """Writes valid rows to one folder and the others, with their violations, to another; each batch is written once to each."""

    def both(batch: DataFrame, number: int) -> None:
        checked = validate(batch, schema).persist()
        checked.where("size(violations) = 0").drop("violations").write.mode("overwrite").parquet(f"{good}/batch={number}")
        checked.where("size(violations) > 0").write.mode("overwrite").parquet(f"{bad}/batch={number}")
        checked.unpersist()

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_of(stream: DataFrame, keys: list[str], time: str, late: str = "30 minutes") -> DataFrame:
    """The stream without repeated keys within the time that rows may be late."""
    return _timed(stream, time).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
