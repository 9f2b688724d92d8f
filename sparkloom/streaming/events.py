"""An extension: the batch operators on streams.  A stream of files or events is parsed without state, repeated ones are
dropped within a watermark, and counts are kept by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(events: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, time: str, by: list[str], width: str = "1 hour", late: str | None = "1 hour") -> DataFrame:
    """(start, by, n) for each window; on a stream, closed windows leave when the watermark has passed them.
    late: None where a step before has set the watermark."""
    rows = events.withWatermark(time, late) if events.isStreaming and late else events
    return rows.groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, time: str, by: list[str], gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    rows = events.withWatermark(time, late) if events.isStreaming and late else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
