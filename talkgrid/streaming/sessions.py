"""Gap merging of flagged intervals on a stream: session windows whose gap is the interval's length plus the
allowed gap, so a session ends that long after the last end in it. Late rows are bounded by the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def span_sessions(events: DataFrame, key: str, start: str, seconds: str, gap: float = 2.0, watermark: str = "10 minutes", label: str | None = None) -> DataFrame:
    """(key, start, end, n[, labels]) of intervals that begin at timestamp `start` and last `seconds`. `end` is the
    last end, without the gap. Works on streams (append mode) and on tables alike."""
    rows = events.withColumn("_end", F.timestamp_micros(F.unix_micros(F.col(start).cast("timestamp")) + F.round(F.col(seconds) * 1_000_000).cast("bigint")))
    rows = rows.withWatermark(start, watermark) if events.isStreaming else rows
    lasts = F.expr(f"make_interval(0, 0, 0, 0, 0, 0, cast({seconds} + {gap} as decimal(18, 6)))")
    extra = [F.collect_set(label).alias("labels")] if label else []
    out = rows.groupBy(key, F.session_window(start, lasts).alias("_w")).agg(F.min(start).alias("start"), F.max("_end").alias("end"), F.count("*").alias("n"), *extra)
    return out.drop("_w")
