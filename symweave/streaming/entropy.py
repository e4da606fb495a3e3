"""Streaming histograms: symbol counts by event-time window, from which entropy follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, symbol: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, sym, n) by tumbling window; with a stream, windows are final once the watermark has passed them."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    counted = timed.groupBy(F.window(ts, window).alias("w"), F.col(symbol).alias("sym")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "sym", "n")


def windowed_entropy(counts: DataFrame) -> DataFrame:
    """(start, h) from windowed_counts() of a batch or a finished sink."""
    total = F.sum("n")
    return counts.groupBy("start").agg((F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias("h"))
