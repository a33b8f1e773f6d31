"""Structured Streaming forms: deduplication of arriving records and counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, text: str, time: str, late: str = "1 hour") -> DataFrame:
    """Rows whose text, apart from case and blanks, didn't arrive before within the time that late rows are waited for."""
    key = F.md5(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))
    return stream.withColumn("text_key", key).withWatermark(time, late).dropDuplicatesWithinWatermark(["text_key"])


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """``(start, key, n)`` by window of event time; a window is final when the watermark has passed it."""
    counts = stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), key, "n")


def run_once(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Write what is there to Parquet and stop; a later call goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
