"""Structured Streaming over the events table: windowed counts and one row for each retry key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _timed(stream: DataFrame) -> DataFrame:
    """With a watermark, which needs timestamps that have a zone."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")


def hourly(stream: DataFrame) -> DataFrame:
    """Counts and sums of each hour and type; hours a day behind the newest event are closed."""
    window = F.window("ts", "1 hour").getField("start").alias("hour")
    return _timed(stream).groupBy(window, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def first_of_each_key(stream: DataFrame) -> DataFrame:
    """The streaming form of deduplication: each key's first row within a day."""
    return _timed(stream).dropDuplicatesWithinWatermark(["user_id", "event_type"])
