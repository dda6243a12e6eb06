"""Streams of task events: counts in windows, sessions, and changes of progress.

Transformations are the same for batch and stream; times are cast to zoned timestamps, which watermarks need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.operators.status import clamp

LATENESS = "1 hour"


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Files under `path` as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events per state in tumbling windows; later ones than the watermark's are dropped in a stream."""
    rows = timed(events).withWatermark("ts", LATENESS) if events.isStreaming else timed(events)
    return rows.groupBy(F.window("ts", width).alias("w"), "state").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "state", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of a task's events with less than `gap` between them."""
    rows = timed(events).withWatermark("ts", LATENESS) if events.isStreaming else timed(events)
    return rows.groupBy("task_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("progress").alias("top")).select("task_id", F.col("w.start").alias("start"), "n", "top")


def _changes(rows: DataFrame, before: Column | None = None) -> DataFrame:
    """Rows whose progress differs from the task's one before, in order of time; `before` is what the first one is held against."""
    w = Window.partitionBy("task_id").orderBy("ts", "event_id")
    last = F.lag("progress").over(w)
    return rows.withColumn("last", last if before is None else F.coalesce(last, before)).where(~F.col("last").eqNullSafe(F.col("progress"))).drop("last")


def progress_changes(events: DataFrame) -> DataFrame:
    """Events whose clamped progress differs from the task's one before (batch form)."""
    return _changes(events.withColumn("progress", clamp(F.col("progress"))))


def write_progress_changes(events: DataFrame, path: str, states: str, checkpoint: str) -> None:
    """The same over what a stream has now: changes go to `path`, the last progress of each task to `states`.

    A micro-batch is one windowed query over its events, joined to the states that the one before it left, so that a
    hot task's events are sorted and spilled by Spark; both results have the batch's number and are overwritten if it
    is repeated. Within a batch events are ordered by time; one that comes in a later batch counts as later.
    """
    spark, state = events.sparkSession, "task_id string, before int"

    def batch(rows: DataFrame, n: int) -> None:
        rows = rows.select("task_id", "ts", "event_id", clamp(F.col("progress")).cast("int").alias("progress"))
        known = spark.read.schema(state).parquet(f"{states}/{n - 1}") if n else spark.createDataFrame([], state)
        _changes(rows.join(known, "task_id", "left"), F.col("before")).select("task_id", "event_id", "progress").write.mode("overwrite").parquet(f"{path}/batch={n}")
        now = rows.groupBy("task_id").agg(F.max_by("progress", F.struct("ts", "event_id")).alias("now"))
        known.join(now, "task_id", "full").select("task_id", F.coalesce("now", "before").alias("before")).write.mode("overwrite").parquet(f"{states}/{n}")

    events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes what is there now to Parquet and ends, exactly once by the checkpoint."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
