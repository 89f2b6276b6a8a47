"""Streaming forms: row operators work on streams as they are; a windowed diversity is our own addition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n) of each window; a stream gives a window once its watermark has passed."""
    base = events.withWatermark("ts", late) if events.isStreaming else events
    return base.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def windowed_shannon(events: DataFrame, types: list[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, n, shannon) of each window over the given event types, in one aggregation, so that a stream needs one state."""
    base = events.withWatermark("ts", late) if events.isStreaming else events
    counts = [F.count_if(F.col("event_type") == t).alias(f"_c{i}") for i, t in enumerate(types)]
    d = base.groupBy(F.window("ts", width).alias("w")).agg(*counts)
    n = sum((F.col(f"_c{i}") for i in range(len(types))), F.lit(0))
    term = lambda c: F.when(c > 0, c / n * F.ln(c / n)).otherwise(F.lit(0.0))
    h = -sum((term(F.col(f"_c{i}")) for i in range(len(types))), F.lit(0.0))
    return d.select(F.col("w.start").alias("start"), n.cast("long").alias("n"), h.alias("shannon"))
