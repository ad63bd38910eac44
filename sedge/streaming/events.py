"""Structured Streaming over the events table. Beyond the dialect, which has no streams: windowed counts, sessions and a running top."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums by type and window; rows later than the watermark are left out."""
    w = F.window("ts", width, slide or width)
    return _timed(events, late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a user: events less than the gap apart."""
    return _timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
