"""Event streams: windowed counts with a watermark; the same plan on a table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """window_start, event_type, n, total of events (ts, event_type, value), batch or stream."""
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,4)")).cast("double"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def stream(spark: SparkSession, path: str, like: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """windowed over new files of a folder; rows later than the watermark are dropped and the state stays bounded."""
    return windowed(spark.readStream.schema(like.schema).parquet(path).withWatermark("ts", late), width)
