"""Review: ranked spans with speakers, clips and marked differences, to rows of a page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrid.functions.fuzzy import token_diff
from talkgrid.functions.text import clock
from talkgrid.operators.intervals import span_names
from talkgrid.operators.ranking import clip_windows, rank_spans
from talkgrid.sources.media import cut_clips
from talkgrid.sources.writers import ReviewRow, review_page


def review_rows(spans: DataFrame, named: DataFrame | None = None, videos: DataFrame | None = None, limit: int | None = None, out_dir: str = "clips", clips: Callable | None = None) -> DataFrame:
    """One row a span in rank order. The limit comes before names and clips, so no work is done for the rest."""
    top = rank_spans(spans, limit)
    rows = span_names(top, named) if named is not None else top.withColumn("name", F.lit(""))
    if videos is not None:
        windows = clip_windows(rows).join(videos.select("recording_id", F.col("path").alias("video")), "recording_id")
        made = cut_clips(windows, out_dir, clips) if clips else cut_clips(windows, out_dir)
        rows = rows.join(made, ["recording_id", "span_idx"], "left")
    else:
        rows = rows.withColumn("clip", F.lit(None).cast("string")).withColumn("made", F.lit(False))
    diff = token_diff(F.col("caption_text"), F.col("asr_text"))
    rows = rows.withColumn("_d", diff).withColumn("timestamp", clock(F.col("start")))
    return rows.select("recording_id", "span_idx", "rank", F.when(F.col("made"), F.col("clip")).alias("clip"), "timestamp", "name", "reasons", F.col("_d.left").alias("caption_html"), F.col("_d.right").alias("asr_html"), "suggestion", F.coalesce("made", F.lit(False)).alias("made"))


def summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("recording_id").agg(F.count("*").alias("n_spans"), F.sum(F.col("made").cast("int")).alias("n_clips"))


def page(rows: DataFrame, recording_id: str, title: str) -> str:
    """The page of one recording; its rows are a ranked, bounded list."""
    got = rows.where(F.col("recording_id") == recording_id).orderBy("rank").collect()
    return review_page([ReviewRow(i, r["clip"], r["timestamp"], r["name"], r["reasons"], r["caption_html"], r["asr_html"], r["suggestion"]) for i, r in enumerate(got)], title)
