"""Windowed counts of event streams (an extension); the same functions serve batch frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, files_a_trigger: int = 1) -> DataFrame:
    """Events from parquet files that arrive in ``folder``, with a time stamp that may carry a watermark."""
    schema = spark.read.parquet(folder).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)
    return with_event_time(rows)


def with_event_time(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", *by: str) -> DataFrame:
    """Counts and sums by window of event time: tumbling, or sliding with ``slide``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = rows.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def session_counts(events: DataFrame, user: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: spans of events with no gap as long as ``gap``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), user).agg(F.count("*").alias("n"))
    return out.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def stream_to_files(stream: DataFrame, folder: str) -> DataFrame:
    """Process all that has arrived in append mode, results below ``folder`` with their checkpoint, and read them back.

    A window or a session comes out once, when the watermark has passed its end, and its state goes. A later call on the
    same folder goes on with the state of the one before: sessions that new rows touch or join are merged in it.
    """
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append")
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def closed(windows: DataFrame, events: DataFrame, end: Column, late: str = "10 minutes") -> DataFrame:
    """Of the windows of a batch of events those that a stream over the same events has given out at its end."""
    last = events.agg((F.max("ts") - F.expr(f"INTERVAL {late}")).alias("_mark"))
    return windows.crossJoin(last).filter(end <= F.col("_mark")).drop("_mark")  # one row


def run_available(stream: DataFrame, table: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that has arrived into a memory table of that name, then stop."""
    query = stream.writeStream.format("memory").queryName(table).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
