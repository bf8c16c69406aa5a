"""Structured Streaming: bars from an event stream, deduplication, keyed upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder, with the schema of what is there."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # A watermark needs a timestamp with a time zone; the tables have none.
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_bars(events: DataFrame, size: str = "1 day", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Bars of ``value`` by ``event_type`` in windows of event time; rows later than ``late`` are dropped."""
    at = F.struct("ts", "event_id")
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("volume"), F.sum("value").alias("amount")
    ).select(F.col("event_type").alias("code"), F.col("w.start").alias("start"), "open", "high", "low", "close", "volume", "amount")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of a user's events, closed by a pause."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("amount")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "amount")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there, once, into a Parquet table; a second run continues from the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)


def for_each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
