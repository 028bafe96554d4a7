"""Extension: findings as a stream. The reference has no streams; these are its deduplication and gate over unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.expr import meets_threshold


def dedupe_stream(findings: DataFrame, event_time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each id of a run once, state bounded by the watermark."""
    return findings.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["run_id", "id"])


def gate_stream(findings: DataFrame, threshold: str, window: str = "10 minutes", event_time: str = "ts", late: str = "1 hour") -> DataFrame:
    """By run and time window: findings, and whether any meets the threshold."""
    w = F.window(event_time, window)
    hit = F.max(F.when(meets_threshold(F.col("severity"), F.lit(threshold)), 1).otherwise(0))
    return findings.withWatermark(event_time, late).groupBy("run_id", w).agg(F.count("*").alias("n_findings"), hit.alias("exit_code")).select("run_id", F.col("window.start").alias("window_start"), "n_findings", "exit_code")
