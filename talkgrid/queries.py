"""Registered queries of the timed-transcript operators over the driver's tables, with DuckDB equivalents.

The tables hold no transcripts, so each operator is reached by an adapter: a user's events stand for a
recording, an event's time and value (minutes) for an interval in whole microseconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkgrid.functions import fuzzy, geometry, text
from talkgrid.operators import flags, glossary, intervals, ranking, spans, votes
from talkgrid.plans import review
from talkgrid.sources import readers, writers
from talkgrid.streaming.sessions import span_sessions

HOUR = 3_600_000_000
GAP = 30 * 60 * 1_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("recording_id"), F.col("event_id"), start.alias("start"), (start + F.round(F.col("value") * 60_000_000).cast("bigint")).alias("end"), "event_type", "value")


def _of_type(spark: SparkSession, sf_dir: str, kind: str, idx: str, label: str | None = None) -> DataFrame:
    e = _events(spark, sf_dir).where(F.col("event_type") == kind)
    return e.select("recording_id", F.col("event_id").alias(idx), "start", "end", *([F.concat(F.lit("s"), (F.col("event_id") % 7).cast("string")).alias(label)] if label else []))


EVENTS = "e AS (SELECT user_id AS recording_id, event_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 60000000) AS BIGINT) AS t, event_type, value FROM events)"
SIDES = f"{EVENTS}, a AS (SELECT * FROM e WHERE event_type = 'view'), b AS (SELECT *, 's' || CAST(event_id % 7 AS VARCHAR) AS speaker FROM e WHERE event_type = 'click')"
FLAT = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
FILL = "('е', 'ее', 'еее', 'ееее', 'эм', 'ем', 'мм', 'ммм', 'хм', 'ну')"
TOKENS = "list_filter(string_split(" + FLAT + ", ' '), lambda t: t <> '' AND t NOT IN " + FILL + ")"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@register(f"""
WITH {EVENTS}, p AS (SELECT *, max(t) OVER (PARTITION BY recording_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM e),
g AS (SELECT *, sum(CASE WHEN m IS NULL OR s - m > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY s, event_id) AS island FROM p)
SELECT recording_id, CAST(island AS BIGINT) AS island, min(s) AS span_start, max(t) AS span_end, count(*) AS n FROM g GROUP BY 1, 2""")
def span_gap_merge(spark, sf_dir):
    g = spans.gap_islands(_events(spark, sf_dir), GAP, "event_id")
    return g.groupBy("recording_id", "island").agg(F.min("start").alias("span_start"), F.max("end").alias("span_end"), F.count("*").alias("n"))


@register(f"""
WITH {EVENTS}, p AS (SELECT *, max(t) OVER (PARTITION BY recording_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM e),
g AS (SELECT *, sum(CASE WHEN m IS NULL OR s - m > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY s, event_id) AS island FROM p)
SELECT recording_id, min(s) AS span_start, max(t) AS span_end, count(*) AS n FROM g GROUP BY recording_id, island""")
def span_sessions_batch(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.round(F.col("value") * 60_000_000) / 1_000_000).alias("seconds"))
    s = span_sessions(e, "user_id", "ts", "seconds", GAP / 1e6)
    return s.select(F.col("user_id").alias("recording_id"), F.unix_micros("start").alias("span_start"), F.unix_micros("end").alias("span_end"), "n")


@register(f"WITH {EVENTS} SELECT a.recording_id, a.event_id AS first_id, b.event_id AS second_id FROM e a JOIN e b ON a.recording_id = b.recording_id AND a.event_id < b.event_id AND a.s < b.t AND b.s < a.t")
def interval_overlap_pairs(spark, sf_dir):
    e = _events(spark, sf_dir).select("recording_id", "event_id", "start", "end")
    p = intervals.overlap_pairs(e, e, HOUR).where("l_event_id < r_event_id")
    return p.select(F.col("l_recording_id").alias("recording_id"), F.col("l_event_id").alias("first_id"), F.col("r_event_id").alias("second_id"))


BEST = "o AS (SELECT a.recording_id, a.event_id, b.speaker, least(a.t, b.t) - greatest(a.s, b.s) AS n, row_number() OVER (PARTITION BY a.event_id ORDER BY least(a.t, b.t) - greatest(a.s, b.s) DESC, b.event_id) AS r FROM a JOIN b ON a.recording_id = b.recording_id AND a.s < b.t AND b.s < a.t AND least(a.t, b.t) > greatest(a.s, b.s))"
NEAR = "d AS (SELECT a.recording_id, a.event_id, b.speaker, row_number() OVER (PARTITION BY a.event_id ORDER BY least(abs(b.s - (a.s + a.t) / 2.0), abs(b.t - (a.s + a.t) / 2.0)), b.event_id) AS r FROM a JOIN b ON a.recording_id = b.recording_id WHERE a.event_id NOT IN (SELECT event_id FROM o))"


@register(f"WITH {SIDES}, {BEST} SELECT recording_id, event_id AS seg_idx, speaker, n AS overlap FROM o WHERE r = 1")
def interval_best_overlap(spark, sf_dir):
    return intervals.best_overlap(_of_type(spark, sf_dir, "view", "seg_idx"), _of_type(spark, sf_dir, "click", "turn_idx", "speaker"), "seg_idx", "turn_idx", "speaker", HOUR)


@register(f"WITH {SIDES}, {BEST}, {NEAR} SELECT recording_id, event_id AS seg_idx, speaker FROM d WHERE r = 1")
def interval_nearest_fallback(spark, sf_dir):
    a, b = _of_type(spark, sf_dir, "view", "seg_idx"), _of_type(spark, sf_dir, "click", "turn_idx", "speaker")
    hit = intervals.best_overlap(a, b, "seg_idx", "turn_idx", "speaker", HOUR).select("recording_id", "seg_idx")
    return intervals.nearest(a.join(hit, ["recording_id", "seg_idx"], "left_anti"), b, "seg_idx", "turn_idx", "speaker")


@register(f"WITH {SIDES}, {BEST}, {NEAR} SELECT a.recording_id, a.event_id AS seg_idx, coalesce(o.speaker, d.speaker, 'UNKNOWN') AS speaker FROM a LEFT JOIN o ON o.event_id = a.event_id AND o.r = 1 LEFT JOIN d ON d.event_id = a.event_id AND d.r = 1")
def speaker_attribution(spark, sf_dir):
    return intervals.attribute(_of_type(spark, sf_dir, "view", "seg_idx"), _of_type(spark, sf_dir, "click", "turn_idx", "speaker"), HOUR).select("recording_id", "seg_idx", "speaker")


@register(f"""
WITH {EVENTS}, a AS (SELECT * FROM e WHERE event_type = 'view'),
p AS (SELECT a.event_id AS i, b.event_type AS x, min(b.event_id) AS f FROM a JOIN e b ON a.recording_id = b.recording_id AND a.s < b.t AND b.s < a.t GROUP BY 1, 2),
g AS (SELECT i, string_agg(x, ' ' ORDER BY f) AS x FROM p GROUP BY 1)
SELECT a.recording_id, a.event_id AS seg_idx, coalesce(g.x, '') AS caption_text FROM a LEFT JOIN g ON g.i = a.event_id""")
def overlap_text_gather(spark, sf_dir):
    cues = _events(spark, sf_dir).select("recording_id", F.col("event_id").alias("cue_idx"), "start", "end", F.concat(F.lit(" "), F.col("event_type"), F.lit("\n")).alias("text"))
    return intervals.gather_text(_of_type(spark, sf_dir, "view", "seg_idx"), cues, "seg_idx", width=HOUR).select("recording_id", "seg_idx", "caption_text")


@register(f"WITH {SIDES}, h AS (SELECT b.recording_id, b.event_id, EXISTS (SELECT 1 FROM a WHERE a.recording_id = b.recording_id AND a.s < b.t AND b.s < a.t) AS hit FROM b) SELECT recording_id, count(*) AS n_cues, CAST(sum(CAST(hit AS INT)) AS BIGINT) AS n_hit, CAST(sum(CAST(hit AS INT)) AS DOUBLE) / count(*) AS fraction FROM h GROUP BY 1")
def cue_hit_fraction(spark, sf_dir):
    return intervals.hit_fraction(_of_type(spark, sf_dir, "click", "cue_idx"), _of_type(spark, sf_dir, "view", "seg_idx"), HOUR)


@register(f"WITH {SIDES}, {BEST} SELECT a.recording_id, a.event_id AS span_idx, coalesce(o.speaker, '') AS name FROM a LEFT JOIN o ON o.event_id = a.event_id AND o.r = 1")
def interval_span_names(spark, sf_dir):
    return intervals.span_names(_of_type(spark, sf_dir, "view", "span_idx"), _of_type(spark, sf_dir, "click", "cue_idx", "name"), HOUR).select("recording_id", "span_idx", "name")


RUNS = f"{EVENTS}, l AS (SELECT *, lag(event_type) OVER (PARTITION BY recording_id ORDER BY event_id) AS q FROM e), g AS (SELECT *, sum(CASE WHEN q = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id ORDER BY event_id) AS run FROM l)"


def _segments(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select("recording_id", F.col("event_id").alias("seg_idx"), "start", "end", F.col("event_type").alias("speaker"), F.concat(F.lit("w"), (F.col("event_id") % 10).cast("string")).alias("text"))


@register(f"WITH {RUNS} SELECT recording_id, CAST(run AS BIGINT) AS run, event_type AS speaker, arg_min(s, event_id) AS start, string_agg('w' || CAST(event_id % 10 AS VARCHAR), ' ' ORDER BY event_id) AS text FROM g GROUP BY 1, 2, 3")
def turn_blocks(spark, sf_dir):
    return spans.speaker_blocks(_segments(spark, sf_dir))


@register(f"WITH {RUNS} SELECT recording_id, CAST(run AS BIGINT) AS run, event_type AS name, arg_min(s, event_id) AS start, coalesce(string_agg('w' || CAST(event_id % 10 AS VARCHAR), ' ' ORDER BY event_id) FILTER (event_id % 10 > 0), '') AS text FROM g GROUP BY 1, 2, 3")
def name_turn_blocks(spark, sf_dir):
    s = _segments(spark, sf_dir).withColumnRenamed("seg_idx", "cue_idx").withColumnRenamed("speaker", "name")
    return spans.name_blocks(s.withColumn("text", F.when(F.col("text") == "w0", " ").otherwise(F.concat(F.lit("\n"), F.col("text")))))


@register(f"WITH {EVENTS}, f AS (SELECT recording_id, CASE WHEN event_type = 'click' THEN 'x SPEAKER_04' ELSE event_type END AS speaker, min(event_id) AS first_idx FROM e GROUP BY 1, 2) SELECT recording_id, speaker, first_idx, 'Speaker ' || CAST(CASE WHEN speaker = 'x SPEAKER_04' THEN 5 ELSE row_number() OVER (PARTITION BY recording_id ORDER BY first_idx) END AS VARCHAR) AS label FROM f")
def speaker_first_seen(spark, sf_dir):
    s = _segments(spark, sf_dir)
    return spans.speaker_labels(s.withColumn("speaker", F.when(F.col("speaker") == "click", "x SPEAKER_04").otherwise(F.col("speaker"))))


@register(f"SELECT doc_id, {FLAT.format('text')} AS norm FROM documents")
def normalize_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("norm"))


@register(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)")
def token_counts(spark, sf_dir):
    t = _table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


PAIRED = """SELECT d.doc_id, d.text, b.caption FROM (SELECT *, (doc_id % n + n) % n AS place FROM documents, (SELECT greatest(count(*), 1) AS n FROM benchmark)) d
LEFT JOIN (SELECT text AS caption, row_number() OVER (ORDER BY item_id, text) - 1 AS place FROM benchmark) b ON b.place = d.place"""


def _paired(spark, sf_dir):
    """Every document with the benchmark item whose place by id is the document's id modulo their number; a
    document without an id, and any if there are no items, with null."""
    b = _table(spark, sf_dir, "benchmark")
    place = F.row_number().over(Window.orderBy("item_id", "text")) - 1
    b = b.select(place.cast("long").alias("_place"), F.col("text").alias("caption_text"))
    return _table(spark, sf_dir, "documents").withColumn("_place", F.expr(f"pmod(doc_id, {max(b.count(), 1)}L)")).join(b, "_place", "left")


CONTAINED = "CASE WHEN len(list_distinct(a)) = 0 THEN 1.0 ELSE CAST(len(list_intersect(list_distinct(a), b)) AS DOUBLE) / len(list_distinct(a)) END"


@register(f"SELECT doc_id, {CONTAINED} AS containment FROM (SELECT doc_id, {TOKENS.format('caption')} AS a, list_distinct({TOKENS.format('text')}) AS b FROM ({PAIRED}))")
def token_containment(spark, sf_dir):
    return _paired(spark, sf_dir).select("doc_id", text.token_containment(F.col("caption_text"), F.col("text")).alias("containment"))


DICTIONARY = f"k AS (SELECT item_id, array_to_string(list_slice(string_split({FLAT.format('text')}, ' '), 1, 2), ' ') AS norm, 'item ' || CAST(item_id AS VARCHAR) AS canonical FROM benchmark)"


def _dictionary(spark, sf_dir):
    heard = F.array_join(F.slice(F.split(text.normalize_text(F.col("text")), " "), 1, 2), " ")
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("int").alias("entry_idx"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("canonical"), F.lit("term").alias("category"), F.lit(None).cast("string").alias("note"), F.array(heard).alias("misheard"))


# one entry for each mishearing: its first place, its last canonical form
INDEX = "x AS (SELECT norm, min(item_id) AS pos, arg_max(canonical, item_id) AS canonical FROM k GROUP BY 1)"


@register(f"WITH {DICTIONARY}, {INDEX}, m AS (SELECT doc_id, arg_min(canonical, pos) AS suggestion FROM (SELECT doc_id, {FLAT.format('text')} AS n FROM documents) d JOIN x ON contains(d.n, x.norm) GROUP BY 1) SELECT d.doc_id, m.suggestion FROM documents d LEFT JOIN m USING (doc_id)")
def misheard_lookup(spark, sf_dir):
    index = flags.misheard_index(_dictionary(spark, sf_dir))
    return flags.find_misheard(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", index, "suggestion").select("doc_id", "suggestion")


@register(f"WITH {DICTIONARY}, {INDEX} SELECT norm AS heard, canonical FROM x")
def misheard_index(spark, sf_dir):
    return flags.misheard_index(_dictionary(spark, sf_dir)).select("heard", "canonical")


FLAGGED = f"""{DICTIONARY}, {INDEX}, p AS ({PAIRED}), n AS (SELECT doc_id, {FLAT.format('text')} AS nt, {FLAT.format('caption')} AS nc, {TOKENS.format('text')} AS a, {TOKENS.format('caption')} AS b FROM p),
m AS (SELECT n.doc_id, arg_min(x.canonical, x.pos) FILTER (contains(nt, x.norm)) AS own, arg_min(x.canonical, x.pos) FILTER (contains(nc, x.norm)) AS cap FROM n CROSS JOIN x GROUP BY 1),
f AS (SELECT n.doc_id, coalesce(own, cap) AS suggestion, {CONTAINED} < 0.5 AS d, (n.doc_id % 10) / -10.0 < -0.8 OR n.doc_id % 4 >= 2 AS u FROM n JOIN m USING (doc_id)),
r AS (SELECT doc_id, suggestion, list_filter([CASE WHEN d THEN 'divergence' END, CASE WHEN u THEN 'low_confidence' END, CASE WHEN suggestion IS NOT NULL THEN 'misheard_match' END], lambda y: y IS NOT NULL) AS reasons FROM f)"""


def _flagged(spark, sf_dir):
    word = F.struct(F.lit("w").alias("w"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.lit(0.3).alias("p"))
    words = F.slice(F.array(word, word, word), 1, F.pmod(F.col("doc_id"), F.lit(4)).cast("int"))
    s = _paired(spark, sf_dir).select(F.lit(0).alias("recording_id"), F.col("doc_id").alias("seg_idx"), "text", "caption_text", ((F.col("doc_id") % 10) / -10.0).alias("avg_logprob"), words.alias("words"))
    return flags.flag_segments(s, flags.misheard_index(_dictionary(spark, sf_dir)), True)


@register(f"WITH {FLAGGED} SELECT doc_id AS seg_idx, array_to_string(reasons, ',') AS reasons, suggestion FROM r WHERE len(reasons) > 0")
def segment_flags(spark, sf_dir):
    return _flagged(spark, sf_dir).select("seg_idx", F.array_join("reasons", ",").alias("reasons"), "suggestion")


@register(f"WITH {FLAGGED} SELECT unnest(reasons) AS reason, count(*) AS n FROM r GROUP BY 1")
def reason_histogram(spark, sf_dir):
    return ranking.reason_counts(_flagged(spark, sf_dir))


LABELLED = "SELECT doc_id % 5 AS recording_id, doc_id AS span_idx, CAST(doc_id % 97 AS DOUBLE) AS start, CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 WHEN doc_id % 3 = 0 THEN 2 ELSE 9 END AS prio FROM labels"


def _spans(spark, sf_dir):
    reasons = F.array_compact(F.array(F.when(F.col("doc_id") % 3 == 0, "low_confidence"), F.when(F.col("quality") == 0, "divergence"), F.when(F.col("toxic") == 1, "misheard_match")))
    return _table(spark, sf_dir, "labels").select((F.col("doc_id") % 5).alias("recording_id"), F.col("doc_id").alias("span_idx"), (F.col("doc_id") % 97).cast("double").alias("start"), ((F.col("doc_id") % 97) + 3.5).cast("double").alias("end"), reasons.alias("reasons"))


@register(f"SELECT recording_id, span_idx, rank FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY prio, start, span_idx) AS rank FROM ({LABELLED})) WHERE rank <= 10")
def rank_spans(spark, sf_dir):
    return ranking.rank_spans(_spans(spark, sf_dir), 10).select("recording_id", "span_idx", F.col("rank").cast("long").alias("rank"))


@register(f"SELECT recording_id, span_idx, prio FROM ({LABELLED}) ORDER BY prio, start, recording_id, span_idx LIMIT 25")
def rank_spans_topn(spark, sf_dir):
    return ranking.top_spans(_spans(spark, sf_dir), 25).select("recording_id", "span_idx", flags.priority(F.col("reasons")).alias("prio"))


@register("SELECT doc_id AS span_idx, greatest(0.0, doc_id % 97 - 5.0) AS clip_start, doc_id % 97 + 3.5 + 5.0 - greatest(0.0, doc_id % 97 - 5.0) AS clip_seconds FROM labels")
def clip_windows(spark, sf_dir):
    return ranking.clip_windows(_spans(spark, sf_dir)).select("span_idx", "clip_start", "clip_seconds")


MERGE = f"""WITH {EVENTS}, p AS (SELECT *, max(t) OVER (PARTITION BY recording_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM e),
g AS (SELECT *, sum(CASE WHEN m IS NULL OR s - m > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY s, event_id) - 1 AS k FROM p),
f AS (SELECT recording_id, k, event_type, min(s) AS s0, arg_min(event_id, (s, event_id)) AS i0 FROM g GROUP BY 1, 2, 3),
r AS (SELECT recording_id, k, string_agg(event_type, ',' ORDER BY s0, i0) AS reasons FROM f GROUP BY 1, 2)
SELECT g.recording_id, CAST(g.k AS INT) AS span_idx, min(s) AS start, max(t) AS "end", string_agg(event_type, ' ' ORDER BY s, event_id) AS caption_text, coalesce(string_agg('x' || CAST(event_id AS VARCHAR), ' ' ORDER BY s, event_id) FILTER (event_id % 2 = 1), '') AS asr_text,
 any_value(r.reasons) AS reasons, arg_min('fix ' || CAST(event_id AS VARCHAR), (s, event_id)) FILTER (event_id % 3 = 0) AS suggestion
FROM g JOIN r ON r.recording_id = g.recording_id AND r.k = g.k GROUP BY 1, 2"""


@register(MERGE)
def merge_spans(spark, sf_dir):
    e = _events(spark, sf_dir)
    rows = e.select(
        "recording_id", F.col("event_id").alias("seg_idx"), "start", "end", F.col("event_type").alias("caption_text"), F.when(F.col("event_id") % 2 == 1, F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise("").alias("asr_text"),
        F.array("event_type").alias("reasons"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("fix "), F.col("event_id").cast("string"))).alias("suggestion"),
    )
    return spans.merge_spans(rows, GAP).withColumn("reasons", F.array_join("reasons", ","))


@register("""WITH n AS (SELECT event_id, CAST(event_id AS DOUBLE) AS s, value AS len, CASE WHEN value <= 0 THEN 1 ELSE greatest(7, CAST(ceil(value / 0.5) AS INT) + 1) END AS n FROM events),
x AS (SELECT *, unnest(range(n)) AS i, CASE WHEN n > 1 THEN (s + len - s) / (n - 1) ELSE 0.0 END AS pitch FROM n)
SELECT event_id, CAST(i AS INT) AS frame_idx, CAST(round_even((s + i * pitch) * 1000, 0) AS BIGINT) AS ms FROM x""")
def cue_frame_times(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", F.col("event_id").cast("double").alias("start"), (F.col("event_id").cast("double") + F.col("value")).alias("end"))
    return spans.cue_frame_times(e).select("event_id", "frame_idx", "ms")


MS = "CAST(round_even((event_id % 9000 + value / 1000) * 1000, 0) AS BIGINT)"


@register(f"SELECT event_id, printf('%02d:%02d:%02d.%03d', {MS} // 3600000, ({MS} // 60000) % 60, ({MS} // 1000) % 60, {MS} % 1000) AS stamp, printf('[%02d:%02d:%02d]', CAST(floor(value * 60) AS BIGINT) // 3600, (CAST(floor(value * 60) AS BIGINT) // 60) % 60, CAST(floor(value * 60) AS BIGINT) % 60) AS clock FROM events")
def timestamp_format(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", text.format_timestamp(F.col("event_id") % 9000 + F.col("value") / 1000).alias("stamp"), text.clock(F.col("value") * 60).alias("clock"))


@register("SELECT event_id, CAST(event_id % 4 AS DOUBLE) * 3600 + CAST(event_id % 60 AS DOUBLE) * 60 + CAST(printf('%02d.%03d', event_id % 50, event_id % 1000) AS DOUBLE) AS seconds FROM events")
def timestamp_parse(spark, sf_dir):
    i = F.col("event_id")
    stamp = F.when(i % 4 == 0, F.format_string("%02d:%02d.%03d", i % 60, i % 50, i % 1000)).otherwise(F.format_string(" %02d:%02d:%02d.%03d", i % 4, i % 60, i % 50, i % 1000))
    return _table(spark, sf_dir, "events").select("event_id", text.parse_timestamp(stamp).alias("seconds"))


OFFSETS = "f AS (SELECT source, doc_id, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM documents)"


def _files(spark, sf_dir):
    return spans.file_offsets(_table(spark, sf_dir, "documents").select(F.col("source").alias("recording_id"), F.col("doc_id").alias("file_idx"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("filename"), F.col("n_chars").alias("duration")))


@register(f"WITH {OFFSETS} SELECT source AS recording_id, doc_id AS file_idx, CAST(o AS BIGINT) AS file_offset, coalesce(CAST(lead(o) OVER (PARTITION BY source ORDER BY doc_id) AS DOUBLE), CAST('inf' AS DOUBLE)) AS next_offset FROM f")
def file_offsets(spark, sf_dir):
    return _files(spark, sf_dir).select("recording_id", "file_idx", F.col("offset").alias("file_offset"), "next_offset")


@register(f"""WITH {OFFSETS}, s AS (SELECT 'src' || CAST(event_id % 20 AS VARCHAR) AS source, event_id, CAST(event_id * 7 AS DOUBLE) AS at FROM events),
n AS (SELECT *, lead(o) OVER (PARTITION BY source ORDER BY doc_id) AS q FROM f)
SELECT s.event_id AS seg_idx, n.doc_id AS file_idx, s.at - n.o AS start FROM s JOIN n ON n.source = s.source AND s.at >= n.o AND (n.q IS NULL OR s.at < n.q) AND (n.q IS NULL OR n.q > n.o)""")
def segment_files(spark, sf_dir):
    at = (F.col("event_id") * 7).cast("double")
    s = _table(spark, sf_dir, "events").select(F.concat(F.lit("src"), (F.col("event_id") % 20).cast("string")).alias("recording_id"), F.col("event_id").alias("seg_idx"), at.alias("start"), (at + 1).alias("end"))
    return intervals.file_of(s, _files(spark, sf_dir)).select("seg_idx", "file_idx", "start")


@register("""WITH v AS (SELECT user_id, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, event_type AS name, count(*) AS n, CAST(sum(event_id % 16) AS DOUBLE) / 16 AS score, min(event_id) AS f FROM events GROUP BY 1, 2, 3)
SELECT user_id AS recording_id, day AS cue_idx, name, n, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY n DESC, score DESC, f) AS r FROM v) WHERE r = 1""")
def majority_vote(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000)
    r = e.select(F.col("user_id").alias("recording_id"), day.alias("cue_idx"), F.col("event_id").alias("frame_idx"), F.col("event_type").alias("name"), ((F.col("event_id") % 16) / 16).alias("score"), F.lit(True).alias("matched"))
    return votes.vote_matched(r)


@register("""SELECT user_id AS recording_id, event_id // 4 AS cue_idx, arg_max(event_type, (event_id % 8, -event_id)) AS name, CAST(max(event_id % 8) AS DOUBLE) AS score FROM events GROUP BY 1, 2""")
def best_engine(spark, sf_dir):
    r = _table(spark, sf_dir, "events").select(F.col("user_id").alias("recording_id"), F.floor(F.col("event_id") / 4).alias("cue_idx"), F.col("event_id").alias("engine_idx"), F.col("event_type").alias("name"), (F.col("event_id") % 8).cast("double").alias("score"), F.lit(True).alias("matched"))
    return votes.best_engine(r, ("recording_id", "cue_idx")).drop("matched")


@register("""WITH l AS (SELECT vec_id, label, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS q, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings),
g AS (SELECT label, i, sum(CASE WHEN q IS NULL OR list_sum(list_transform(range(1, len(embedding) + 1), lambda k: abs(CAST(embedding[k] AS DOUBLE) - CAST(q[k] AS DOUBLE)))) > 4.0 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id) AS run FROM l)
SELECT label AS recording_id, CAST(min(i) AS INT) AS first, CAST(max(i) AS INT) AS last, CAST((min(i) + max(i)) // 2 AS INT) AS representative FROM g GROUP BY label, run""")
def change_points(spark, sf_dir):
    return spans.change_points(_table(spark, sf_dir, "embeddings").withColumnRenamed("label", "recording_id"), "embedding", "vec_id", 4.0)


@register("""WITH t AS (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS s FROM documents) SELECT source AS recording_id, doc_id AS entry_idx FROM t WHERE s <= 40000""")
def prefix_budget(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select(F.col("source").alias("recording_id"), F.col("doc_id").alias("entry_idx"), F.col("n_chars").alias("n_tokens"))
    return spans.within_budget(d, 40_000).select("recording_id", "entry_idx")


@register("""WITH f AS (SELECT user_id, event_id, value AS l, value + 0.05 AS r FROM events), w AS (SELECT *, max(r) OVER (PARTITION BY user_id ORDER BY l, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM f),
c AS (SELECT *, sum(CASE WHEN e IS NOT NULL AND l - e > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY l, event_id) AS k FROM w) SELECT user_id AS recording_id, event_id AS frag_idx FROM c WHERE k = 0""")
def leftmost_fragments(spark, sf_dir):
    f = _table(spark, sf_dir, "events").select(F.col("user_id").alias("recording_id"), F.col("event_id").alias("frag_idx"), F.col("value").alias("left"), (F.col("value") + 0.05).alias("right"))
    return spans.leftmost_cluster(f, 0.5, ("recording_id",)).select("recording_id", "frag_idx")


@register("SELECT p_partkey AS entry_idx, row_number() OVER (ORDER BY CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END, p_partkey) AS rank FROM part")
def hotword_order(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("person", "company", "product", "term"))), (F.col("p_size") % 4 + 1).cast("int"))
    return ranking.hotwords(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry_idx"), kind.alias("category"))).select("entry_idx", F.col("rank").cast("long").alias("rank"))


@register("""SELECT 'canonical' AS kind, lower(p_name) AS key FROM part GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'misheard', lower(p_type) FROM part GROUP BY 2 HAVING count(DISTINCT p_name) > 1""")
def glossary_conflicts(spark, sf_dir):
    return glossary.conflicts(_table(spark, sf_dir, "part").select(F.col("p_name").alias("canonical"), F.array("p_type").alias("misheard")))


@register("""WITH g AS (SELECT n_name AS canonical, 'term' AS category, lower(n_name) AS h, n_nationkey AS e FROM nation),
c AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'new ' || CAST(c_custkey % 7 AS VARCHAR) ELSE n_name END AS canonical, 'heard ' || CAST(c_custkey % 50 AS VARCHAR) AS h, c_custkey AS j FROM customer JOIN nation ON c_nationkey = n_nationkey),
d AS (SELECT canonical, lower(h) AS k, arg_min(h, j) AS h, min(j) AS j FROM c GROUP BY 1, 2),
u AS (SELECT canonical, category, h, 0 AS w, CAST(0 AS BIGINT) AS j FROM g UNION ALL SELECT canonical, 'person', h, 1, j FROM d)
SELECT canonical, arg_min(category, (w, j)) AS category, string_agg(h, ',' ORDER BY w, j) AS misheard FROM u GROUP BY 1""")
def glossary_merge(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    g = n.select(F.col("n_nationkey").alias("entry_idx"), F.col("n_name").alias("canonical"), F.lit("term").alias("category"), F.lit(None).cast("string").alias("note"), F.array(F.lower("n_name")).alias("misheard"))
    c = _table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("new "), (F.col("c_custkey") % 7).cast("string"))).otherwise(F.col("n_name"))
    c = c.select(F.col("c_custkey").alias("corr_idx"), name.alias("canonical"), F.concat(F.lit("heard "), (F.col("c_custkey") % 50).cast("string")).alias("heard"), F.lit("person").alias("category"))
    return glossary.merge_at_scale(g, c).select("canonical", "category", F.array_join("misheard", ",").alias("misheard"))


@register("""SELECT event_id, replace(replace(replace(replace(replace(props || '<' || event_type || '''&', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM events""")
def html_escape(spark, sf_dir):
    raw = F.concat("props", F.lit("<"), "event_type", F.lit("'&"))
    return _table(spark, sf_dir, "events").select("event_id", text.escape_html(raw).alias("escaped"))


@register("""WITH t AS (SELECT event_id, (event_id % 10) / 20.0 AS x, (event_id % 7) / 20.0 AS y, (event_id % 9 + 1) / 20.0 AS w, (event_id % 20 + 1) / 20.0 AS h FROM events),
p AS (SELECT *, CAST(round_even(x * 1920, 0) AS INT) AS px, CAST(round_even(y * 1080, 0) AS INT) AS py, CAST(round_even(w * 1920, 0) AS INT) AS pw, CAST(round_even(h * 1080, 0) AS INT) AS ph FROM t),
b AS (SELECT *, least(greatest(CAST(round_even(0.22 * ph, 0) AS INT), 24), 64, ph) AS bh, least(pw, 560) AS bw FROM p)
SELECT event_id, CASE WHEN w * h >= 0.6 OR h >= 0.95 THEN 'full_frame' ELSE 'screen_share_pip' END AS layout, greatest(0, least(px, greatest(0, 1920 - bw))) / 1920.0 AS band_x, greatest(0, least(py + ph - bh, greatest(0, 1080 - bh))) / 1080.0 AS band_y, bw / 1920.0 AS band_w, bh / 1080.0 AS band_h FROM b""")
def tile_geometry(spark, sf_dir):
    i = F.col("event_id")
    tile = F.struct(((i % 10) / 20.0).alias("x"), ((i % 7) / 20.0).alias("y"), ((i % 9 + 1) / 20.0).alias("w"), ((i % 20 + 1) / 20.0).alias("h"))
    band = geometry.name_band(F.col("t"), F.lit(1920), F.lit(1080))
    e = _table(spark, sf_dir, "events").select("event_id", tile.alias("t")).select("event_id", geometry.layout(F.array("t")).alias("layout"), band.alias("b"))
    return e.select("event_id", "layout", F.col("b.x").alias("band_x"), F.col("b.y").alias("band_y"), F.col("b.w").alias("band_w"), F.col("b.h").alias("band_h"))


def _vtt_files(spark, sf_dir):
    i = F.col("event_id")
    cue = F.concat(F.format_string("%d\r\n%02d:%02d.%03d --> %02d:%02d.%03d\r\n", i, i % 60, i % 60, i % 1000, i % 60 + 1, i % 60, i % 1000), F.when(i % 3 == 0, F.concat(F.lit("Ann: "), F.col("event_type"), F.lit("\r\nmore"))).otherwise(F.col("event_type")))
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(i, cue.alias("c")))), lambda r: r["c"]), "\r\n\r\n")
    raw = F.concat(F.lit("WEBVTT\r\nKind: captions\r\n\r\nNOTE --> none\r\n\r\n"), rows, F.lit("\r\n"))
    return _table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("recording_id")).agg(raw.alias("raw"))


@register("""SELECT CAST(user_id AS VARCHAR) AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS cue_idx, CAST(event_id % 60 AS DOUBLE) * 60 + CAST(printf('%02d.%03d', event_id % 60, event_id % 1000) AS DOUBLE) AS start,
CASE WHEN event_id % 3 = 0 THEN 'Ann: ' || event_type || chr(10) || 'more' ELSE event_type END AS text, CASE WHEN event_id % 3 = 0 THEN 'Ann' ELSE '' END AS name FROM events""")
def vtt_cues(spark, sf_dir):
    return readers.named_cues(readers.parse_vtt(_vtt_files(spark, sf_dir))).select("recording_id", F.col("cue_idx").cast("long").alias("cue_idx"), "start", "text", "name")


@register("SELECT DISTINCT CAST(user_id AS VARCHAR) AS recording_id, 'WEBVTT' || chr(10) || 'Kind: captions' AS header FROM events")
def vtt_headers(spark, sf_dir):
    return readers.vtt_headers(_vtt_files(spark, sf_dir))


@register("""WITH g AS (SELECT user_id, event_id, 'word ' || CAST(event_id % 5 AS VARCHAR) AS text FROM events) SELECT CAST(user_id AS VARCHAR) AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seg_idx,
CAST(event_id AS DOUBLE) AS start, CASE WHEN event_id % 2 = 0 THEN 'S' ELSE 'UNKNOWN' END AS speaker, text, CAST(event_id % 3 AS BIGINT) AS n_words FROM g""")
def transcript_scan(spark, sf_dir):
    i = F.col("event_id")
    words = F.array_join(F.array_repeat(F.lit('{"w":" a","start":0,"end":1,"p":0.5}'), (i % 3).cast("int")), ",")
    one = F.concat(F.format_string('{"start":%d,"end":%d,"text":"word %d"', i, i + 1, i % 5), F.when(i % 2 == 0, ',"speaker":"S"').otherwise(""), F.when(i % 3 > 0, F.concat(F.lit(',"words":['), words, F.lit("]"))).otherwise(""), F.lit("}"))
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(i, one.alias("c")))), lambda r: r["c"]), ",")
    files = _table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("recording_id")).agg(F.concat(F.lit('{"language":"en","segments":['), rows, F.lit("]}")).alias("raw")).withColumn("path", F.col("recording_id"))
    s = readers.segments_of(readers.parse_transcripts(files))
    return s.select("recording_id", F.col("seg_idx").cast("long").alias("seg_idx"), "start", "speaker", "text", F.size("words").cast("long").alias("n_words"))


@register(f"""WITH {RUNS}, l2 AS (SELECT recording_id, event_type, 'Speaker ' || CAST(row_number() OVER (PARTITION BY recording_id ORDER BY min(event_id)) AS VARCHAR) AS label FROM e GROUP BY 1, 2),
b AS (SELECT recording_id, run, event_type, arg_min(event_id, event_id) AS i, string_agg('w' || CAST(event_id % 10 AS VARCHAR), ' ' ORDER BY event_id) AS x FROM g GROUP BY 1, 2, 3)
SELECT b.recording_id, string_agg(printf('[%02d:%02d:%02d] ', i // 3600, (i // 60) % 60, i % 60) || label || ':' || chr(10) || x, chr(10) || chr(10) ORDER BY run) AS document FROM b JOIN l2 ON l2.recording_id = b.recording_id AND l2.event_type = b.event_type GROUP BY 1""")
def transcript_text(spark, sf_dir):
    return writers.transcript_text(_segments(spark, sf_dir).withColumn("start", F.col("seg_idx").cast("double")))


@register(f"WITH {RUNS}, b AS (SELECT recording_id, run, event_type, min(event_id) AS i, string_agg('w' || CAST(event_id % 10 AS VARCHAR), ' ' ORDER BY event_id) AS x FROM g GROUP BY 1, 2, 3) SELECT recording_id, string_agg(printf('[%02d:%02d:%02d] ', i // 3600, (i // 60) % 60, i % 60) || event_type || ':' || chr(10) || x, chr(10) || chr(10) ORDER BY run) || chr(10) AS document FROM b GROUP BY 1")
def annotation_text(spark, sf_dir):
    s = _segments(spark, sf_dir)
    return writers.annotation_text(s.select("recording_id", F.col("seg_idx").alias("cue_idx"), F.col("seg_idx").cast("double").alias("start"), F.col("speaker").alias("name"), "text"))


@register("""SELECT user_id AS recording_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(printf('00:%02d:%02d.000 --> 00:%02d:%02d.500', event_id % 60, event_id % 60, event_id % 60, event_id % 60) || chr(10) || event_type || CASE WHEN event_id % 3 = 0 THEN ':' ELSE ': hi' || chr(10) || 'you' END || chr(10), chr(10) ORDER BY event_id) AS document FROM events GROUP BY 1""")
def named_vtt(spark, sf_dir):
    i = F.col("event_id")
    at = (i % 60 * 61).cast("double")
    c = _table(spark, sf_dir, "events").select(F.col("user_id").alias("recording_id"), i.alias("cue_idx"), at.alias("start"), (at + 0.5).alias("end"), F.when(i % 3 == 0, "").otherwise("hi\nyou").alias("text"), F.col("event_type").alias("name"))
    return writers.named_vtt(c, c.select("recording_id").distinct().withColumn("header", F.lit("WEBVTT")))


@register("""WITH s AS (SELECT doc_id, '{"start":' || CAST(CAST(doc_id % 97 AS DOUBLE) AS VARCHAR) || ',"end":' || CAST(doc_id % 97 + CAST(3.5 AS DOUBLE) AS VARCHAR) || ',"meet_text":"a","asr_text":"b","reasons":['
|| array_to_string(list_filter([CASE WHEN doc_id % 3 = 0 THEN '"low_confidence"' END, CASE WHEN quality = 0 THEN '"divergence"' END, CASE WHEN toxic = 1 THEN '"misheard_match"' END], lambda x: x IS NOT NULL), ',') || '],"suggestion":null}' AS j FROM labels)
SELECT doc_id % 5 AS recording_id, '{"spans":[' || string_agg(j, ',' ORDER BY doc_id) || ']}' AS document FROM s GROUP BY 1""")
def flags_json(spark, sf_dir):
    s = _spans(spark, sf_dir).withColumns({"caption_text": F.lit("a"), "asr_text": F.lit("b"), "suggestion": F.lit(None).cast("string")})
    return writers.flags_json(s)


def _readings(spark, sf_dir):
    """Customers' nations as readings, cut and garbled by rule, against all nations."""
    n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    names = n.agg(F.transform(F.sort_array(F.collect_list(F.struct("c_nationkey", "n_name"))), lambda x: x["n_name"]).alias("candidates"))
    c = _table(spark, sf_dir, "customer").join(n, "c_nationkey").crossJoin(F.broadcast(names))
    k = F.col("c_custkey") % 4
    seen = F.when(k == 0, F.col("n_name")).when(k == 1, F.concat(F.substring("n_name", 1, 5), F.lit("..."))).when(k == 2, F.concat(F.lit("X"), F.substring("n_name", 2, 20))).otherwise("Guest Person")
    return c.select(F.col("c_nationkey").alias("recording_id"), F.floor(F.col("c_custkey") / 40).alias("cue_idx"), F.col("c_custkey").alias("frame_idx"), fuzzy.resolve(seen, F.col("candidates")).alias("m"))


@register()
def name_resolve(spark, sf_dir):
    return _readings(spark, sf_dir).select("frame_idx", "m.name", F.round("m.score", 9).alias("score"), "m.matched")


@register()
def fuzzy_vote(spark, sf_dir):
    v = votes.vote_cues(_readings(spark, sf_dir).select("recording_id", "cue_idx", "frame_idx", "m.*"))
    return v.select("recording_id", "cue_idx", "name", "frames_used", F.to_json("votes").alias("votes"))


@register()
def token_diff(spark, sf_dir):
    return _paired(spark, sf_dir).select("doc_id", fuzzy.token_diff(F.col("caption_text"), F.col("text")).alias("d")).select("doc_id", "d.left", "d.right")


@register("""WITH t AS (SELECT event_id AS i, (event_id % 8) / 8.0 AS ax, (event_id % 4) / 8.0 AS ay, (event_id % 5) / 8.0 AS aw, (event_id % 3) / 8.0 AS ah, (event_id % 7) / 8.0 AS bx, (event_id % 6) / 8.0 AS byy, (event_id % 9) / 8.0 AS bw, (event_id % 2) / 8.0 AS bh FROM events),
o AS (SELECT *, greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, byy + bh) - greatest(ay, byy)) AS both_of FROM t)
SELECT i AS event_id, CASE WHEN aw * ah + bw * bh - both_of > 0 THEN CAST(both_of AS DOUBLE) / CAST(aw * ah + bw * bh - both_of AS DOUBLE) ELSE 0 END AS iou FROM o""")
def box_overlap(spark, sf_dir):
    box = lambda *n: F.struct(*[(F.col("event_id") % k / 8).alias(c) for c, k in zip("xywh", n, strict=True)])
    return _table(spark, sf_dir, "events").select("event_id", geometry.iou(box(8, 4, 5, 3), box(7, 6, 9, 2)).alias("iou"))


@register("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN 'full_frame' ELSE 'screen_share_pip' END ELSE 'gallery' END AS layout, CASE WHEN event_id % 4 = 1 THEN 'camera' END AS kind FROM events""")
def tile_layouts(spark, sf_dir):
    i = F.col("event_id")
    side = F.when(i % 3 == 0, 1.0).otherwise(0.5)  # a high tile, or with i % 5 a large one, or a small one
    tile = F.struct(F.lit("camera").alias("kind"), F.when(i % 5 == 0, 0.9).otherwise(0.25).alias("w"), F.greatest(side, F.when(i % 5 == 0, 0.75).otherwise(0.0)).alias("h"))
    tiles = _table(spark, sf_dir, "events").select("event_id", F.array_repeat(tile, (i % 4).cast("int")).alias("t"))
    return tiles.select("event_id", geometry.layout(F.col("t")).alias("layout"), geometry.speaker_tile(F.col("t"))["kind"].alias("kind"))


NAMED = "SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'Unknown' ELSE c_mktsegment END AS name FROM customer"


@register(f"SELECT * FROM ({NAMED}) WHERE name IS NULL OR name NOT IN ('BUILDING', 'MACHINERY')")
def cues_to_review(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 11 == 0, None).when(F.col("c_custkey") % 7 == 0, "Unknown").otherwise(F.col("c_mktsegment"))
    return ranking.needs_review(_table(spark, sf_dir, "customer").select("c_custkey", name.alias("name")), glossary.candidates(["BUILDING"], ["MACHINERY"]))


@register("SELECT c_custkey AS recording_id, i AS frame_idx, CAST(i * 2.5 + 1.25 AS DOUBLE) AS time FROM customer, unnest(generate_series(0, 9)) AS g(i) WHERE i * 2.5 <= c_custkey % 20 + 0.5 AND i * 2.5 + 1.25 <= c_custkey % 20 + 0.5")
def grid_frame_times(spark, sf_dir):
    videos = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("recording_id"), (F.col("c_custkey") % 20 + 0.5).cast("double").alias("duration"))
    return spans.grid_times(videos, 2.5, 1.25).select("recording_id", F.col("frame_idx").cast("long").alias("frame_idx"), "time")


@register("""WITH f AS (SELECT user_id, event_id, value AS l, value + 0.05 AS r, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'w' || CAST(event_id % 10 AS VARCHAR) END AS text, (event_id % 4) / 4.0 AS p FROM events),
w AS (SELECT *, max(r) OVER (PARTITION BY user_id ORDER BY l, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM f WHERE text <> ''),
c AS (SELECT *, sum(CASE WHEN e IS NOT NULL AND l - e > 0.12 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY l, event_id) AS k FROM w),
n AS (SELECT user_id, string_agg(text, ' ' ORDER BY l, event_id) AS text, CAST(sum(p) AS DOUBLE) / count(*) AS confidence FROM c WHERE k = 0 GROUP BY 1)
SELECT u.user_id AS recording_id, coalesce(text, '') AS text, coalesce(confidence, 0) AS confidence FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN n ON n.user_id = u.user_id""")
def frame_readings(spark, sf_dir):
    i = F.col("event_id")
    word = F.when(i % 5 == 0, "  ").otherwise(F.concat(F.lit(" w"), (i % 10).cast("string"), F.lit(" ")))
    f = _table(spark, sf_dir, "events").select(F.col("user_id").alias("recording_id"), i.alias("frag_idx"), F.col("value").alias("left"), (F.col("value") + 0.05).alias("right"), word.alias("text"), (i % 4 / 4).alias("confidence"))
    return spans.reading_of(f, ("recording_id",))


@register("SELECT row_number() OVER (ORDER BY f, k) - 1 AS entry_idx, canonical, f AS file_idx FROM (SELECT 0 AS f, n_nationkey AS k, n_name AS canonical FROM nation UNION ALL SELECT 1, r_regionkey, r_name FROM region)")
def glossary_union(spark, sf_dir):
    parts = [_table(spark, sf_dir, t).select(F.col(f"{t[0]}_{t}key").cast("long").alias("entry_idx"), F.col(f"{t[0]}_name").alias("canonical")) for t in ("nation", "region")]
    return glossary.union(parts).select(F.col("entry_idx").cast("long").alias("entry_idx"), "canonical", "file_idx")


@register("""WITH s AS (SELECT event_id, event_id % 4 AS n, (event_id % 10) / -10.0 AS p FROM events)
SELECT 0 AS setting, event_id AS seg_idx FROM s WHERE p < -0.8 UNION ALL SELECT 1, event_id FROM s WHERE p < -0.2 OR n >= 3 UNION ALL SELECT 2, event_id FROM s WHERE p < -0.8 OR n >= 1""")
def threshold_sweep(spark, sf_dir):
    i = F.col("event_id")
    word = F.struct(F.lit("w").alias("w"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.lit(0.5).alias("p"))
    s = _table(spark, sf_dir, "events").select(i.alias("seg_idx"), F.col("event_type").alias("text"), (i % 10 / -10).alias("avg_logprob"), F.array_repeat(word, (i % 4).cast("int")).alias("words"))
    settings = [flags.Thresholds(), flags.Thresholds(word_p_min=0.6, low_word_min=3, seg_logprob_min=-0.2), flags.Thresholds(word_p_min=0.6, low_word_min=1)]
    return flags.sweep(s, None, False, settings).select("setting", "seg_idx")


@register("SELECT doc_id % 5 AS recording_id, count(*) AS n_spans, count(*) FILTER (toxic = 1) AS n_clips FROM labels GROUP BY 1")
def review_counts(spark, sf_dir):
    return review.summary(_table(spark, sf_dir, "labels").select((F.col("doc_id") % 5).alias("recording_id"), (F.col("toxic") == 1).alias("made")))


@register("SELECT event_id, '<b>' || event_type || '</b> ' || props AS plain FROM events")
def stripped_marks(spark, sf_dir):
    marked = F.concat(F.lit("<mark><b></mark>"), "event_type", F.lit("</b> <mark>"), "props", F.lit("</mark>"))
    return _table(spark, sf_dir, "events").select("event_id", text.strip_marks(marked).alias("plain"))
