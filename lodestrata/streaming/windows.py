"""Rates over time: a sliding window over stored events, and tumbling windows of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_rate(events: DataFrame, key: str, at: str, seconds: int, limit: int) -> DataFrame:
    """events plus n, the key's events in the seconds up to each one, and limited (n beyond the limit).

    The window is dealt by key and reads each key's rows in order of time.
    """
    n = F.expr(f"count(*) over (partition by `{key}` order by `{at}` range between interval {int(seconds)} seconds preceding and current row)")
    return events.withColumn("n", n).withColumn("limited", F.col("n") > limit)


def tumbling_rate(events: DataFrame, key: str, at: str, width: str, late: str) -> DataFrame:
    """Events by key and window; on a stream, state older than `late` behind the newest event is dropped."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    out = rows.groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
