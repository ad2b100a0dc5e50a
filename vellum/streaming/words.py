"""Word counts of documents that arrive over time. An extension: streams have no counterpart among the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums of events by type and window; events later than the watermark don't count. Works on streams and on tables."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def word_stream(documents: DataFrame) -> DataFrame:
    """A running count of words of a stream of documents."""
    words = documents.select(F.explode(F.split(F.coalesce("text", F.lit("")), r"[ \t-\r]+")).alias("word")).filter("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))
