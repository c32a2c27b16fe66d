"""Scenes that arrive over time: reports kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def scene_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files of pixels (with a time column) as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_report(stream: DataFrame, band: str, time: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Pixels and mean of each value by window of time; what is later than `late` is not waited for."""
    own = stream.withWatermark(time, late).where(F.col(band).isNotNull())
    return own.groupBy(F.window(time, window).alias("w"), F.col(band).alias("value")).agg(F.count("*").alias("pixels")).select(F.col("w.start").alias("start"), "value", "pixels")
