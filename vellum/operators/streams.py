"""The streaming extension's batch form, as a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.plans.publish import native
from vellum.streaming.words import windowed_counts


@native("", "event_windows", "Events by type and hour, as the stream counts them.", "SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return counts.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")
