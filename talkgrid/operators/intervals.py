"""Interval joins. Spark has none, so both sides are dealt into buckets of time and equi-joined.

A pair may share several buckets; it is kept in the first one only, so no deduplication is needed. The key
is (recording, bucket), which also splits one very long recording over tasks. Touching ends don't overlap;
an empty interval inside another does. Times are seconds as double, or any unit as integer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkgrid.functions.text import flatten_space, ordered_join

KEY = "recording_id"


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def overlap_length(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def _dealt(df: DataFrame, side: str, width: float) -> DataFrame:
    """Columns renamed with a prefix, one row for each bucket the interval touches."""
    out = df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns])
    first = F.floor(F.col(f"{side}_start") / width)
    last = F.floor(F.greatest(F.col(f"{side}_end"), F.col(f"{side}_start")) / width)
    return out.withColumn(f"_{side}0", first).withColumn("_bucket", F.explode(F.sequence(first, last)))


def overlap_pairs(left: DataFrame, right: DataFrame, width: float = 60, key: str = KEY) -> DataFrame:
    """All overlapping pairs within a recording; columns prefixed l_ and r_. Both sides need key, start, end."""
    a, b = _dealt(left, "l", width), _dealt(right, "r", width).withColumnRenamed("_bucket", "_other")
    on = (F.col(f"l_{key}") == F.col(f"r_{key}")) & (F.col("_bucket") == F.col("_other")) & overlaps(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end"))
    return a.join(b, on).where(F.col("_bucket") == F.greatest("_l0", "_r0")).drop("_l0", "_r0", "_bucket", "_other")


def best_overlap(left: DataFrame, right: DataFrame, left_idx: str, right_idx: str, label: str, width: float = 60, key: str = KEY) -> DataFrame:
    """(key, left_idx, label, overlap): the right row that overlaps most, the first on ties. Left rows without
    a positive overlap are not in the result."""
    pairs = overlap_pairs(left.select(key, left_idx, "start", "end"), right.select(key, right_idx, "start", "end", label), width, key)
    length = overlap_length(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end"))
    best = F.max(F.struct(length.alias("n"), (-F.col(f"r_{right_idx}")).alias("i"), F.col(f"r_{label}").alias("v")))
    picked = pairs.where(length > 0).groupBy(f"l_{key}", f"l_{left_idx}").agg(best.alias("_b"))
    return picked.select(F.col(f"l_{key}").alias(key), F.col(f"l_{left_idx}").alias(left_idx), F.col("_b.v").alias(label), F.col("_b.n").alias("overlap"))


def nearest(left: DataFrame, right: DataFrame, left_idx: str, right_idx: str, label: str, key: str = KEY) -> DataFrame:
    """(key, left_idx, label): the right row with a start or end closest to the middle of the left row, the
    first on ties. Two passes of one window over the merged boundaries: the last at or before the middle, and
    the first at or after it; no pairing of all with all."""
    points = right.select(key, F.explode(F.array("start", "end")).alias("at"), F.col(right_idx).alias("_i"), F.col(label).alias("_v"))
    points = points.groupBy(key, "at").agg(F.min(F.struct(F.col("_i").alias("i"), F.col("_v").alias("v"))).alias("_p"))
    middles = left.select(key, ((F.col("start") + F.col("end")) / 2).alias("at"), F.col(left_idx).alias("_l"))
    points = points.select(key, F.col("at").cast("double").alias("at"), F.struct(F.col("at").cast("double").alias("at"), F.col("_p.i").alias("i"), F.col("_p.v").alias("v")).alias("_p"), F.lit(None).cast(middles.schema["_l"].dataType).alias("_l"))
    middles = middles.select(key, F.col("at").cast("double").alias("at"), F.lit(None).cast(points.schema["_p"].dataType).alias("_p"), "_l")
    by = Window.partitionBy(key).orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy(key).orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    merged = points.unionByName(middles).withColumn("_a", F.last("_p", ignorenulls=True).over(by)).withColumn("_b", F.last("_p", ignorenulls=True).over(back)).where("_l IS NOT NULL")
    far = lambda p: F.struct(F.abs(F.col("at") - F.col(f"{p}.at")).alias("d"), F.col(f"{p}.i").alias("i"), F.col(f"{p}.v").alias("v"))
    near = F.array_min(F.filter(F.array(F.when(F.col("_a").isNotNull(), far("_a")), F.when(F.col("_b").isNotNull(), far("_b"))), lambda x: x.isNotNull()))
    return merged.withColumn("_n", near).where("_n IS NOT NULL").select(key, F.col("_l").alias(left_idx), F.col("_n.v").alias(label))


def attribute(segments: DataFrame, turns: DataFrame, width: float = 60, unknown: str = "UNKNOWN", key: str = KEY) -> DataFrame:
    """Segments with the speaker of the turn that overlaps most, else of the nearest turn, else `unknown`."""
    best = best_overlap(segments, turns, "seg_idx", "turn_idx", "speaker", width, key).select(key, "seg_idx", F.col("speaker").alias("_best"))
    tried = segments.drop("speaker").join(best, [key, "seg_idx"], "left")
    missed = tried.where("_best IS NULL").select(key, "seg_idx", "start", "end")
    near = nearest(missed, turns, "seg_idx", "turn_idx", "speaker", key).select(key, "seg_idx", F.col("speaker").alias("_near"))
    return tried.join(near, [key, "seg_idx"], "left").withColumn("speaker", F.coalesce("_best", "_near", F.lit(unknown))).drop("_best", "_near")


def gather_text(left: DataFrame, cues: DataFrame, left_idx: str, out: str = "caption_text", width: float = 60, key: str = KEY) -> DataFrame:
    """Left rows with the texts of overlapping cues, in cue order, white space flattened, empty and repeated
    texts left out, one space between; "" if there are none."""
    pairs = overlap_pairs(left.select(key, left_idx, "start", "end"), cues.select(key, "cue_idx", "start", "end", "text"), width, key)
    rows = F.sort_array(F.collect_list(F.struct(F.col("r_cue_idx").alias("i"), flatten_space(F.col("r_text")).alias("t"))))
    found = pairs.groupBy(f"l_{key}", f"l_{left_idx}").agg(ordered_join(rows, "t", distinct=True).alias("_t"))
    found = found.select(F.col(f"l_{key}").alias(key), F.col(f"l_{left_idx}").alias(left_idx), "_t")
    return left.join(found, [key, left_idx], "left").withColumn(out, F.coalesce("_t", F.lit(""))).drop("_t")


def hit_fraction(cues: DataFrame, segments: DataFrame, width: float = 60, key: str = KEY) -> DataFrame:
    """(key, n_cues, n_hit, fraction): the share of a recording's cues that any segment overlaps."""
    hit = overlap_pairs(cues.select(key, "cue_idx", "start", "end"), segments.select(key, "start", "end"), width, key).groupBy(F.col(f"l_{key}").alias(key)).agg(F.countDistinct("l_cue_idx").alias("n_hit"))
    total = cues.groupBy(key).agg(F.count("*").alias("n_cues"))
    return total.join(hit, key, "left").select(key, "n_cues", F.coalesce("n_hit", F.lit(0)).alias("n_hit")).withColumn("fraction", F.col("n_hit") / F.col("n_cues"))


def span_names(spans: DataFrame, named_cues: DataFrame, width: float = 60, key: str = KEY) -> DataFrame:
    """Spans with the name of the cue that overlaps most, "" if none does."""
    best = best_overlap(spans, named_cues, "span_idx", "cue_idx", "name", width, key).select(key, "span_idx", "name")
    return spans.join(best, [key, "span_idx"], "left").withColumn("name", F.coalesce("name", F.lit("")))


def file_of(segments: DataFrame, boundaries: DataFrame, key: str = KEY) -> DataFrame:
    """Segments with file_idx, filename, and start and end counted from the start of their file. A file holds
    the starts in [offset, next offset). An as-of lookup: boundaries and segments in one window."""
    b = boundaries.select(key, F.col("offset").cast("double").alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col("file_idx"), F.col("filename"), F.col("offset")).alias("_f"))
    s = segments.withColumn("_at", F.col("start").cast("double")).withColumn("_kind", F.lit(1))
    merged = s.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_at", "_kind", "_f.file_idx").rowsBetween(Window.unboundedPreceding, 0)
    placed = merged.withColumn("_f", F.last("_f", ignorenulls=True).over(w)).where((F.col("_kind") == 1) & F.col("_f").isNotNull())
    return placed.withColumns({"file_idx": F.col("_f.file_idx"), "filename": F.col("_f.filename"), "start": F.col("start") - F.col("_f.offset"), "end": F.col("end") - F.col("_f.offset")}).drop("_at", "_kind", "_f")
