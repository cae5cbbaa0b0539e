"""Structured Streaming forms of the health and heartbeat operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS_DDL = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_at_once: int = 8) -> DataFrame:
    """A stream over a folder of event files, with a proper time column."""
    raw = spark.readStream.schema(EVENTS_DDL).option("maxFilesPerTrigger", files_at_once).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def failure_rates(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(started, user_id, events, failures) per tumbling window; rows later than the watermark are dropped."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), "user_id")
        .agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("failures"))
        .select(F.col("w.start").alias("started"), "user_id", "events", "failures")
    )


def heartbeats(events: DataFrame, gap: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, started, ended, beats) per burst of events; a burst ends when nothing came for ``gap``."""
    return (
        events.withWatermark("ts", late)
        .groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("beats"))
        .select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "beats")
    )


def run_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there and stop; final windows are appended as Parquet, exactly once."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
