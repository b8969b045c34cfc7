"""An extension: gap sessions over a stream of events, with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_sessions(events: DataFrame, gap: str = "20 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, s, e, members) of sessions: events of a user less than ``gap`` apart. ``events`` (user_id, ts timestamp) may be a stream; the state of a session goes once the watermark has passed it."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = own.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("members"), F.max("ts").alias("last"))
    return grouped.select("user_id", F.col("w.start").alias("s"), F.col("last").alias("e"), "members")


def state_changes(events: DataFrame, threshold: float, late: str = "1 hour") -> DataFrame:
    """(user_id, hour, high, low): events above and below a threshold for each user and hour, for streams and tables."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    counts = own.groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count_if(F.col("value") >= threshold).alias("high"), F.count_if(F.col("value") < threshold).alias("low"))
    return counts.select("user_id", F.col("w.start").alias("hour"), "high", "low")
