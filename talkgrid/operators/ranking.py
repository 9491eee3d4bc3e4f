"""Ranking, limits and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkgrid.operators.flags import priority

KEY = "recording_id"

# The categories whose words recognisers miss most come first.
CATEGORY_ORDER = {"person": 0, "company": 1, "product": 2, "term": 3}


def rank_spans(spans: DataFrame, limit: int | None = None, key: str = KEY) -> DataFrame:
    """Spans with `rank` from 1 in their recording: by best reason, then start, then place; the first `limit`."""
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    w = Window.partitionBy(key).orderBy(priority(F.col("reasons")), "start", "span_idx")
    out = spans.withColumn("rank", F.row_number().over(w))
    return out if limit is None else out.where(F.col("rank") <= limit)


def top_spans(spans: DataFrame, limit: int) -> DataFrame:
    """The first spans over all recordings: a bounded sort on each task, then one merge."""
    return spans.orderBy(priority(F.col("reasons")), "start", "recording_id", "span_idx").limit(limit)


def reason_counts(spans: DataFrame) -> DataFrame:
    return spans.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def hotwords(glossary: DataFrame) -> DataFrame:
    """Entries with `rank` from 1, by category, then place. A glossary is small, one task sorts it."""
    order = F.coalesce(*[F.when(F.col("category") == k, v) for k, v in CATEGORY_ORDER.items()], F.lit(len(CATEGORY_ORDER)))
    return glossary.withColumn("rank", F.row_number().over(Window.orderBy(order, "entry_idx")))


def needs_review(named: DataFrame, candidates: list[str], unknown: str = "Unknown") -> DataFrame:
    """Rows whose name is unknown or not a candidate."""
    return named.where((F.col("name") == unknown) | F.col("name").isNull() | ~F.col("name").isin(candidates))


def clip_windows(spans: DataFrame, pad: float = 5.0) -> DataFrame:
    """Spans with clip_start, not below 0, and clip_seconds, `pad` seconds added on either side."""
    return spans.withColumn("clip_start", F.greatest(F.lit(0.0), F.col("start") - pad)).withColumn("clip_seconds", F.col("end") + pad - F.col("clip_start"))
