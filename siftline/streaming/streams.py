"""Findings and events as streams: windowed counts, first sightings, and the upkeep of tables batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftline.operators.findings import clean_severity
from siftline.session import new_table_path


def stream_table(spark: SparkSession, folder: str, name: str, files: int = 4) -> DataFrame:
    """A stream over the files of a table, `files` of them in each micro-batch."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/{name}.parquet*")


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 day", late: str = "60 days") -> DataFrame:
    """(window_start, by, n): rows in tumbling windows; windows older than `late` leave the state, and what comes later still is dropped.

    Findings arrive weeks late; for input that isn't in order of time, `late` has to span all of it.
    """
    w = F.window(at, width)
    return stream.withWatermark(at, late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def session_counts(stream: DataFrame, at: str, by: str, gap: str = "6 hours", late: str = "60 days") -> DataFrame:
    """(by, session_start, session_end, n): rows in sessions that end after `gap` without one; `late` as in windowed_counts()."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def first_seen(stream: DataFrame, key: str, at: str, within: str = "60 days") -> DataFrame:
    """The first row of each key within the watermark's delay; the state of older keys is dropped."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def drained(stream: DataFrame, name: str, mode: str = "complete", keys: tuple[str, ...] = ()) -> DataFrame:
    """What a stream gives once all of its present input is read: each micro-batch's result is written to the shared folder and read back.

    append: all rows. update: the last row of each of `keys`; only what has changed is written, and state that the
    watermark has passed is dropped. complete: the last batch, for results that are small and never closed.
    """
    spark = stream.sparkSession
    path = new_table_path(spark, name)

    def put(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={no}")

    q: StreamingQuery = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{path}/out/batch=-1")
    out = spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out")
    if mode == "update":
        rest = [c for c in stream.columns if c not in keys]
        last = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x"))
        return last.select(*(c if c in keys else f"x.{c}" for c in stream.columns))
    if mode == "complete":
        out = out.where(F.col("batch") == out.agg(F.max("batch")).first()[0])
    return out.drop("batch")


def each_batch(stream: DataFrame, name: str, step: Callable[[DataFrame, int], None]) -> None:
    """Runs `step` on each micro-batch of the present input, exactly once for each number across restarts."""
    path = new_table_path(stream.sparkSession, name)
    stream.writeStream.option("checkpointLocation", f"{path}/state").foreachBatch(step).trigger(availableNow=True).start().awaitTermination()


def severity_days(spark: SparkSession, folder: str) -> DataFrame:
    """Findings by day of scanning and severity, from a stream. A table's files are in no order of time, so the delay spans its years."""
    s = stream_table(spark, folder, "findings").select(F.col("scanned_at"), clean_severity("severity").alias("severity"))
    return drained(windowed_counts(s, "scanned_at", "severity", late="1500 days"), "days", "update", ("window_start", "severity"))
