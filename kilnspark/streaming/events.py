"""Streaming forms of event operators (extensions: the batch forms are in operators.ledger)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_events(spark: SparkSession, path: str, *, files_per_trigger: int = 100) -> DataFrame:
    """A Parquet folder of events as a stream, with the schema of what is there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def rate_windows(events: DataFrame, *, every: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Events for each user in tumbling windows; rows later than the watermark are dropped. Works on batch and streaming frames."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    return timed.groupBy("user_id", F.window("ts", every).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Activity sessions of each user (a lease that lapses after `gap` without an event)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def first_calls(calls: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """The first of the calls with one fingerprint: idempotency keys, within the watermark on streams."""
    timed = calls.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["fingerprint"]) if timed.isStreaming else timed.dropDuplicates(["fingerprint"])
