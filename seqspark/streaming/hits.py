"""Hits and events as streams: the same sums, kept up to date as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Parquet files as they come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def stream_sum_per_hit(hits: DataFrame, subject: str = "sseqid", hit: str = "hit_id", time: str = "loaded_at", delay: str = "7 days") -> DataFrame:
    """(subject, total): hits per subject, each hit counted once however often it's delivered within the delay."""
    return hits.filter(F.col(subject).isNotNull() & F.col(hit).isNotNull()).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([hit]).groupBy(subject).agg(F.count(F.lit(1)).alias("total"))


def stream_windows(events: DataFrame, width: str = "1 hour", time: str = "ts", key: str = "event_type", delay: str = "1 day") -> DataFrame:
    """(start, key, n) of tumbling windows; those older than the delay are final."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
