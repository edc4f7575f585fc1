"""An extension: the event image kept up to date from a stream, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Events as they arrive as Parquet files in a folder; the schema is that of the files there."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def hourly_image(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """y = user, hour window, v = sum of values; windows close once the watermark passes them."""
    hours = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("w"), F.col("user_id").alias("y")).agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    return hours.select("y", F.col("w.start").alias("hour"), "v", "n")
