"""Crosscheck: transcript segments against captions and a glossary, to merged spans to look at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrid.operators.flags import Thresholds, flag_segments, misheard_index
from talkgrid.operators.intervals import gather_text, hit_fraction
from talkgrid.operators.spans import merge_spans

LEAST_HIT = 0.20


def crosscheck(segments: DataFrame, cues: DataFrame | None, glossary: DataFrame | None, thresholds: Thresholds = Thresholds(), least_hit: float = LEAST_HIT) -> DataFrame:
    """Spans (recording_id, span_idx, start, end, caption_text, asr_text, reasons, suggestion). Where captions are
    given, a recording of whose cues less than `least_hit` meet a segment raises when its rows are read."""
    rows = segments
    if cues is not None:
        rows = gather_text(segments, cues, "seg_idx")
        hit = segments.select("recording_id").distinct().join(hit_fraction(cues, segments), "recording_id", "left")
        low = F.coalesce("fraction", F.lit(0.0)) < least_hit
        text = F.concat(F.lit("Only "), F.round(100 * F.coalesce("fraction", F.lit(0.0))).cast("int").cast("string"), F.lit("% of the captions meet a segment: "), F.col("recording_id").cast("string"))
        hit = hit.select("recording_id", F.when(low, F.raise_error(text).cast("double")).otherwise(F.col("fraction")).alias("_hit"))
        rows = rows.join(hit, "recording_id").where("_hit IS NOT NULL").drop("_hit")
    index = misheard_index(glossary) if glossary is not None else None
    flagged = flag_segments(rows, index, cues is not None, thresholds).withColumnRenamed("text", "asr_text")
    return merge_spans(flagged, thresholds.merge_gap)
