"""Extension: review sessions, runs of a key's events with no gap of `gap` or more between them. One plan for tables and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: list[str], event_time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, session_start, session_end, n_events): a session ends `gap` after its last event.

    Of a stream, sessions are final once the watermark (`late` behind the latest event) has passed their end; events behind it are left out. A table has no watermark: all its events count. Events without a time or a key are in no session.
    """
    rows = events.where(F.col(event_time).isNotNull())
    for c in key:
        rows = rows.where(F.col(c).isNotNull())
    if events.isStreaming:
        rows = rows.withWatermark(event_time, late)
    each = rows.groupBy(*key, F.session_window(event_time, gap).alias("session")).agg(F.count("*").alias("n_events"))
    return each.select(*key, F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), "n_events")
