"""Telemetry and usage as streams. Each takes a streaming DataFrame and returns one; the caller writes it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.sources import otel


def live_events(exports: DataFrame, prefix: str, late: str = "1 hour") -> DataFrame:
    """Events once each: a repeated delivery within the watermark is dropped."""
    rows = otel.events(exports, prefix).withColumn("ts", F.timestamp_micros("ts_us"))
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key"])


def latest_series(points: DataFrame) -> DataFrame:
    """The latest value of each cumulative series (update mode): an older export that comes late changes nothing."""
    return points.groupBy("key", "metric", "type", "model").agg(
        F.max_by("value", F.struct("ts_us", "value")).alias("value"), F.max("ts_us").alias("ts_us")
    )


def session_spans(rows: DataFrame) -> DataFrame:
    """First and last time of each session so far (update mode)."""
    return rows.groupBy("session_id").agg(F.min("ts_us").alias("started_us"), F.max("ts_us").alias("ended_us"))


def usage_windows(rows: DataFrame, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Requests and tokens by time bucket and model, over rows with a timestamp `ts`."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", every), "model").agg(
        F.count("*").alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")
    ).select(F.col("window.start").alias("start"), "model", "requests", "input_tokens", "output_tokens")


def idle_islands(rows: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Stretches of work of each session without a pause of `gap`."""
    return rows.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap)).agg(F.count("*").alias("requests")).select(
        "session_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "requests"
    )
