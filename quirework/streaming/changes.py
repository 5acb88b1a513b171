"""Changes as streams: last written positions and sessions of edits. Each also takes a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, ts: str) -> DataFrame:
    """``ts`` as a time with zone, which a watermark needs; the session's zone should be UTC."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def positions(events: DataFrame, key: list[str], ts: str, value: str, tie: str) -> DataFrame:
    """The last value written for each key so far; its state is a row a key. For update or complete mode."""
    return events.groupBy(*key).agg(F.max(F.struct(ts, tie, value)).alias("m")).select(*key, f"m.{ts}", f"m.{value}")


def sessions(events: DataFrame, key: list[str], ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a key's events less than ``gap`` apart: how many and their span. Streams drop what is later than ``late``."""
    events = events.withWatermark(ts, late) if events.isStreaming else events
    spans = events.groupBy(*key, F.session_window(ts, gap)).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return spans.drop("session_window")
