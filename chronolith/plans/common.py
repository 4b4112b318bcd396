"""Tables and streams that the registered queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(column: str):
    """Seconds of a timestamp without zone, as a double."""
    return F.unix_micros(F.col(column).cast("timestamp")) / 1_000_000.0


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as sampled time lines: track user_id, clock t in hours, value."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", epoch("ts").alias("seconds"))
    return events.withColumn("t", F.col("seconds") / 3600.0)


#: The same as SQL.
SAMPLES_SQL = "SELECT user_id, event_id, event_type, value, epoch_us(ts) / 1000000.0 AS seconds, epoch_us(ts) / 1000000.0 / 3600.0 AS t FROM events"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as transcript segments: track conv_id, clock turn in units of 30 s."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("track"), F.col("turn").alias("ord"), (F.col("turn") * 30.0).alias("start"), (F.col("turn") * 30.0 + 25.0).alias("end"), "text", "role")
