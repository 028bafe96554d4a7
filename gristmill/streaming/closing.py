"""Extension: sessions that one of their own events can close, or else a timeout. A window by time can't say that, so a stream keeps state by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gristmill.sources.shared import materialize

STATE = "start long, last long, n long, times array<long>, ties array<long>, ends array<boolean>"


def closed_sessions(events: DataFrame, key: list[str], closes: Column, event_time: str = "ts", tie: str = "event_id", gap_seconds: int = 1800, late: str = "1 hour", block_seconds: int = 86400) -> DataFrame:
    """(key, session_start, last_event, n_events, closed): an event is in the session of the one before it, unless that closes its session or lies gap_seconds back or more.

    Events are in the order of their time and, of equal times, of tie (a number, null for 0). An event whose closes is null does not close. Those without a time or a key are in no
    session. A stream gives each session once, when the watermark (late behind the last event) is past all that could belong to it, and leaves out events behind the watermark; a table gives all.
    """
    time = F.col(event_time).cast("timestamp")
    rows = events.where(F.col(event_time).isNotNull())
    for c in key:
        rows = rows.where(F.col(c).isNotNull())
    if events.isStreaming:
        rows = rows.withWatermark(event_time, late)
    rows = rows.select(*key, event_time, F.unix_micros(time).alias("__t"), F.coalesce(F.col(tie).cast("long"), F.lit(0)).alias("__tie"), F.coalesce(closes, F.lit(False)).alias("__ends"))
    out = of_stream(rows, key, gap_seconds * 1_000_000) if events.isStreaming else of_table(rows.drop(event_time), key, gap_seconds * 1_000_000, block_seconds * 1_000_000)
    return out.select(*key, F.timestamp_micros("start").alias("session_start"), F.timestamp_micros("last").alias("last_event"), F.col("n").alias("n_events"), "closed")


def of_table(rows: DataFrame, key: list[str], gap: int, block: int) -> DataFrame:
    """A key's time is cut into blocks that are sorted apart from each other; the last event and the number of sessions of those before one are carried into it."""
    event = F.struct("__t", "__tie", "__ends")
    rows = rows.withColumn("__block", F.floor(F.col("__t") / block))
    parts = [*key, "__block"]
    blocks = Window.partitionBy(*key).orderBy("__block")
    before = rows.groupBy(*parts).agg(F.max(event).alias("__last")).select(*parts, F.lag("__last").over(blocks).alias("__prior"))
    own = Window.partitionBy(*parts).orderBy("__t", "__tie", "__ends")
    rows = rows.join(before, parts).withColumn("__prior", F.coalesce(F.lag(event).over(own), "__prior"))
    fresh = F.col("__prior").isNull() | F.col("__prior.__ends") | (F.col("__t") - F.col("__prior.__t") >= gap)
    rows = rows.withColumn("__new", F.coalesce(fresh, F.lit(True)).cast("long")).withColumn("__i", F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # a piece of a session in each block; the first may go on from the block before
    pieces = materialize(rows.groupBy(*parts, "__i").agg(F.min("__t").alias("start"), F.max("__t").alias("last"), F.count("*").alias("n"), F.max("__ends").alias("closed")), "session-pieces")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.groupBy(*parts).agg(F.max("__i").alias("__n")).select(*parts, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    whole = pieces.join(carried, parts).groupBy(*key, (F.col("__i") + F.col("__base")).alias("__number"))
    return whole.agg(F.min("start").alias("start"), F.max("last").alias("last"), F.sum("n").alias("n"), F.max("closed").alias("closed"))


def of_stream(rows: DataFrame, key: list[str], gap: int) -> DataFrame:
    """State of a key: its open session, and the events that the watermark hasn't passed yet, as earlier ones may still come."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start = last = n = 0
        waiting: list[tuple] = []
        if state.exists:
            start, last, n, *lists = state.get
            waiting = list(zip(*lists))
        for pdf in frames:
            waiting += zip(pdf["__t"].tolist(), pdf["__tie"].tolist(), pdf["__ends"].tolist())
        mark, out = state.getCurrentWatermarkMs() * 1000, []
        waiting.sort()
        sure = [x for x in waiting if x[0] < mark]
        waiting = waiting[len(sure) :]
        for t, _, ends in sure:
            if n and t - last >= gap:
                out.append((*k, start, last, n, False))
                n = 0
            start, last, n = (start if n else t), t, n + 1
            if ends:
                out.append((*k, start, last, n, True))
                n = 0
        if n and last + gap <= mark:
            out.append((*k, start, last, n, False))
            n = 0
        if n or waiting:
            state.update((start, last, n, *([x[i] for x in waiting] for i in range(3))))
            state.setTimeoutTimestamp(min([x[0] for x in waiting[:1]] + [last + gap] * (n > 0)) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[*key, "start", "last", "n", "closed"])

    kinds = rows.schema
    given = T.StructType([*[kinds[c] for c in key], *[T.StructField(c, T.LongType()) for c in ("start", "last", "n")], T.StructField("closed", T.BooleanType())])
    return rows.groupBy(*key).applyInPandasWithState(step, given, STATE, "append", GroupStateTimeout.EventTimeTimeout)
