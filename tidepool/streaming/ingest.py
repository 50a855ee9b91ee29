"""Streaming front ends of the batch operators: trailing ingest and windowed counts on event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_landing(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _timed(stream: DataFrame, at: str, late: str) -> DataFrame:
    """Event time as a timestamp (the session's zone for stamps without one) with its watermark."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def fresh_articles(stream: DataFrame, key: str = "article_id", at: str = "ts", late: str = "3 days") -> DataFrame:
    """Articles once each: event time is publication, repeats within the watermark go."""
    return _timed(stream, at, late).dropDuplicatesWithinWatermark([key])


def daily_scores(stream: DataFrame, at: str = "ts", late: str = "3 days") -> DataFrame:
    """Count and mean score of each type and day, closed once the watermark has passed."""
    return (_timed(stream, at, late).groupBy(F.window(at, "1 day").alias("w"), "event_type")
            .agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.to_date("w.start").alias("date"), "event_type", "n", "mean_value"))


def write_once(stream: DataFrame, path: str, checkpoint: str):
    """Run what is there and stop: the batch schedule's replacement."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
