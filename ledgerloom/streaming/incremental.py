"""An incremental ledger over a stream of events; an extension, as no stream is known elsewhere.

State is bounded by watermarks: each aggregate closes once its window is past the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prepared(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events with an instant, their amount in cents, each event_id once within the delay."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("amount_c", F.round(F.col("value") * 100).cast("long"))
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def daily_totals(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """(d, event_type, n, amount_c): a row once its day is complete."""
    g = prepared(events, delay).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("amount_c").alias("amount_c"))
    return g.select(F.to_date("window.start").alias("d"), "event_type", "n", "amount_c")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """(user_id, start, stop, n) of bursts of activity."""
    g = prepared(events, delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")
