"""Gap merging and runs of equal labels: windows that turn rows into islands, then one aggregation.

Windows are per recording, the unit of parallelism. A recording is one meeting, so a partition is bounded
by its length; keys hotter than that should be cut by day or file first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkgrid.functions.text import flatten_space, ordered_join

KEY = "recording_id"


def gap_islands(df: DataFrame, gap: Column | float, order: str, key: str = KEY) -> DataFrame:
    """Rows with `island`: a row starts a new one where it begins more than `gap` after all earlier ends. The
    running maximum over the whole recording equals that of the island, as a new island starts after it."""
    w = Window.partitionBy(key).orderBy("start", order)
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    limit = gap if isinstance(gap, Column) else F.lit(gap)
    fresh = (before.isNull() | (F.col("start") - before > limit)).cast("int")
    return df.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def merge_spans(flagged: DataFrame, gap: float = 2.0, key: str = KEY) -> DataFrame:
    """Flagged segments (key, seg_idx, start, end, caption_text, asr_text, reasons, suggestion) to spans:
    segments at most `gap` apart become one, with the union of reasons in order of appearance, texts joined
    (empty ones left out) and the first suggestion there is. span_idx counts from 0."""
    rows = F.sort_array(F.collect_list(F.struct("start", "seg_idx", "caption_text", "asr_text", "reasons", "suggestion")))
    grouped = gap_islands(flagged, gap, "seg_idx", key).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), rows.alias("_r"))
    reasons = F.array_distinct(F.flatten(F.transform("_r", lambda x: x["reasons"])))
    suggestion = F.get(F.filter(F.transform("_r", lambda x: x["suggestion"]), lambda s: s.isNotNull()), F.lit(0))
    return grouped.select(
        key, (F.col("island") - 1).cast("int").alias("span_idx"), "start", "end", ordered_join(F.col("_r"), "caption_text").alias("caption_text"),
        ordered_join(F.col("_r"), "asr_text").alias("asr_text"), reasons.alias("reasons"), suggestion.alias("suggestion"),
    )


def runs(df: DataFrame, label: str, order: list[str], key: str | list[str] = KEY) -> DataFrame:
    """Rows with `run`: it goes up by one where the label differs from the row before (nulls are equal)."""
    w = Window.partitionBy(key).orderBy(*order)
    same = F.lag(F.struct(label)).over(w).eqNullSafe(F.struct(F.col(label)))
    return df.withColumn("_new", (~same).cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def speaker_blocks(segments: DataFrame, key: str | list[str] = KEY) -> DataFrame:
    """(key, run, speaker, start, text): neighbouring segments of one speaker, texts joined as they are; the
    block starts with its first segment. `key` may hold a file as well."""
    keys = [key] if isinstance(key, str) else key
    rows = F.sort_array(F.collect_list(F.struct("seg_idx", "start", "text")))
    grouped = runs(segments, "speaker", ["seg_idx"], keys).groupBy(*keys, "run", "speaker").agg(rows.alias("_r"))
    return grouped.select(*keys, "run", "speaker", F.get(F.col("_r"), F.lit(0))["start"].alias("start"), ordered_join(F.col("_r"), "text", skip_empty=False).alias("text"))


def name_blocks(cues: DataFrame, key: str = KEY) -> DataFrame:
    """(key, run, name, start, text): neighbouring cues of one name, flattened texts joined, empty ones left out."""
    rows = F.sort_array(F.collect_list(F.struct("cue_idx", "start", flatten_space(F.col("text")).alias("t"))))
    grouped = runs(cues, "name", ["cue_idx"], key).groupBy(key, "run", "name").agg(rows.alias("_r"))
    return grouped.select(key, "run", "name", F.get(F.col("_r"), F.lit(0))["start"].alias("start"), ordered_join(F.col("_r"), "t").alias("text"))


def speaker_labels(segments: DataFrame, key: str = KEY) -> DataFrame:
    """(key, speaker, first_idx, label): `Speaker n`, n one more than the number in SPEAKER_n anywhere in the
    name, else the place in order of appearance. Labels may collide."""
    first = segments.groupBy(key, "speaker").agg(F.min("seg_idx").alias("first_idx"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("first_idx"))
    number = F.regexp_extract(F.col("speaker"), r"SPEAKER_(\d+)", 1)
    return first.withColumn("label", F.concat(F.lit("Speaker "), F.when(number != "", number.try_cast("bigint") + 1).otherwise(rank).cast("string")))


def file_offsets(files: DataFrame, key: str = KEY) -> DataFrame:
    """Files (key, file_idx, filename, duration) with `offset`, the sum of durations before, and `next_offset`,
    infinite for the last."""
    w = Window.partitionBy(key).orderBy("file_idx")
    out = files.withColumn("offset", F.coalesce(F.sum("duration").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.withColumn("next_offset", F.coalesce(F.lead("offset").over(w).cast("double"), F.lit(float("inf"))))


def change_points(frames: DataFrame, features: str, order: str, threshold: float = 0.08, key: str = KEY) -> DataFrame:
    """(key, first, last, representative): runs of frames whose feature vectors move by at most `threshold` (L1)
    from one to the next; places count from 0, the representative is the middle one, rounded down."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.lag(features).over(w)
    moved = F.aggregate(F.zip_with(features, before, lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    placed = frames.withColumn("_i", F.row_number().over(w) - 1).withColumn("_new", F.when(before.isNull() | (moved > threshold), 1).otherwise(0))
    cut = placed.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = cut.groupBy(key, "run").agg(F.min("_i").alias("first"), F.max("_i").alias("last"))
    return out.select(key, "first", "last", F.floor((F.col("first") + F.col("last")) / 2).cast("int").alias("representative"))


def leftmost_cluster(fragments: DataFrame, gap: float = 0.12, keys: tuple[str, ...] = (KEY, "frame_idx")) -> DataFrame:
    """Text fragments (keys, left, right, text, confidence) up to the first gap wider than `gap`, from the left."""
    w = Window.partitionBy(*keys).orderBy("left", "frag_idx")
    edge = F.max("right").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = fragments.withColumn("_cut", F.when(edge.isNotNull() & (F.col("left") - edge > gap), 1).otherwise(0))
    return cut.withColumn("_cut", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_cut = 0").drop("_cut")


def reading_of(fragments: DataFrame, keys: tuple[str, ...] = (KEY, "frame_idx")) -> DataFrame:
    """(keys, text, confidence): the leftmost cluster's texts joined, mean confidence; "" and 0 without any."""
    real = fragments.where(F.trim("text") != "").withColumn("text", F.trim("text"))
    rows = F.sort_array(F.collect_list(F.struct("left", "frag_idx", "text")))
    found = leftmost_cluster(real, keys=keys).groupBy(*keys).agg(ordered_join(rows, "text").alias("text"), F.avg("confidence").alias("confidence"))
    return fragments.select(*keys).distinct().join(found, list(keys), "left").na.fill({"text": "", "confidence": 0.0})


def within_budget(terms: DataFrame, budget: int = 221, key: str = KEY) -> DataFrame:
    """Terms (key, entry_idx, n_tokens) up to the first whose running total exceeds the budget."""
    w = Window.partitionBy(key).orderBy("entry_idx")
    total = F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    over = F.max((F.col("_t") > budget).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return terms.withColumn("_t", total).withColumn("_o", over).where("_o = 0").drop("_t", "_o")


def cue_frame_times(cues: DataFrame, least: int = 7, step: float = 0.5) -> DataFrame:
    """One row for each moment to look at: `least` or more evenly spaced times from start to end, about `step`
    apart; just the start for an empty cue. `ms` names the frame, halves to even."""
    length = F.col("end") - F.col("start")
    n = F.when(length <= 0, F.lit(1)).otherwise(F.greatest(F.lit(least), F.ceil(length / step) + 1)).cast("int")
    pitch = F.when(n > 1, length / (n - 1)).otherwise(F.lit(0.0))
    times = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.col("start") + i * pitch)
    out = cues.select("*", F.posexplode(times).alias("frame_idx", "time"))
    return out.withColumn("ms", F.bround(F.col("time") * 1000, 0).cast("bigint"))


def grid_times(videos: DataFrame, interval: float, offset: float = 0.0) -> DataFrame:
    """Every `interval` seconds of a video (key, duration), shifted by `offset`."""
    n = F.floor(F.col("duration") / interval).cast("int")
    return videos.select("*", F.explode(F.sequence(F.lit(0), n)).alias("frame_idx")).withColumn("time", F.col("frame_idx") * interval + offset).where("time <= duration")
