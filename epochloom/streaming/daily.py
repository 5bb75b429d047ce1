"""Epochs as a stream: daily sums with a bound on lateness. An extension; scores that look ahead need the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochloom.schema import EpochSchema


def daily_stream(epochs: DataFrame, s: EpochSchema, *, label: str, lateness: str = "2 days", start_hour: int = 0) -> DataFrame:
    """(pid, ``day_start``, ``n_epochs``, ``n_sleep``, ``tst_min``) of a streaming (or plain) epoch table.

    Epochs that come more than ``lateness`` after the newest are dropped from the state; copies (same participant and
    time) within it count once. The time column must be a TIMESTAMP.
    """
    once = epochs.withWatermark(s.time, lateness).dropDuplicatesWithinWatermark([s.pid, s.time]) if epochs.isStreaming else epochs.dropDuplicates([s.pid, s.time])
    day = F.window(s.time, "24 hours", startTime=f"{int(start_hour)} hours")
    out = once.groupBy(s.pid, day.alias("w")).agg(F.count("*").alias("n_epochs"), F.sum(F.coalesce(F.col(label).cast("int"), F.lit(0))).alias("n_sleep"))
    return out.select(s.pid, F.col("w.start").alias("day_start"), "n_epochs", "n_sleep", (F.col("n_sleep") / F.lit(s.per_minute)).alias("tst_min"))
