"""Readers: transcript and flags JSON, WebVTT, glossary, roster and corrections YAML, file lists.

Many files are read by Spark, one row a file, and parsed in expressions; a file's name without its
extensions is its recording_id unless a folder pattern says otherwise. YAML is small and read on the driver.
"""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkgrid.errors import CrosscheckError, DictionaryError, TalkgridError
from talkgrid.functions.text import parse_timestamp
from talkgrid.operators.glossary import Correction, Entry, check

WORD = "struct<w:string,start:double,end:double,p:double>"
SEGMENT = f"struct<start:double,end:double,speaker:string,text:string,avg_logprob:double,words:array<{WORD}>>"
TRANSCRIPT = f"struct<language:string,model:string,hotwords_from:array<string>,segments:array<{SEGMENT}>>"
GLOSSARY = "entry_idx int, canonical string, category string, note string, misheard array<string>"

#: A line that starts with a time and an arrow.
_TIMING = r"^\s*\d{1,2}:\d{2}(:\d{2})?[.,]\d{1,3}\s*-->"


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(recording_id, path, raw): whole text files, one row each."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\..*$", "")
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw")).select(name.alias("recording_id"), "path", "raw")


def parse_transcripts(files: DataFrame, strict: bool = True) -> DataFrame:
    """(recording_id, language, model, hotwords_from, segments) of transcript files. A file that is no JSON, has no
    `segments`, or a segment without times, raises when read (strict) or comes out null."""
    doc = F.from_json("raw", TRANSCRIPT)
    bad = doc.isNull() | F.col("_d.segments").isNull() | F.exists("_d.segments", lambda s: s["start"].isNull() | s["end"].isNull())
    out = files.withColumn("_d", doc)
    if strict:
        out = out.withColumn("_d", F.when(bad, F.raise_error(F.concat(F.lit("not a transcript: "), "path")).cast(TRANSCRIPT)).otherwise(F.col("_d")))
    return out.select("recording_id", "_d.language", "_d.model", F.coalesce("_d.hotwords_from", F.array().cast("array<string>")).alias("hotwords_from"), "_d.segments", "raw")


def segments_of(transcripts: DataFrame) -> DataFrame:
    """One row a segment, missing optional keys given their defaults. An explicit null stays null: a key counts
    as missing by the raw JSON, not by its value."""
    raw = F.from_json("raw", "struct<segments:array<map<string,string>>>")["segments"]
    rows = transcripts.withColumn("_raw", raw).select("recording_id", F.posexplode(F.arrays_zip("segments", "_raw")).alias("seg_idx", "_s"))
    s = lambda c: F.col(f"_s.segments.{c}")
    has = lambda c: F.map_contains_key(F.col("_s._raw"), c)
    given = lambda c, default: F.when(has(c), s(c)).otherwise(default)
    return rows.select(
        "recording_id", "seg_idx", s("start").alias("start"), s("end").alias("end"), given("speaker", F.lit("UNKNOWN")).alias("speaker"), given("text", F.lit("")).alias("text"),
        given("avg_logprob", F.lit(0.0)).alias("avg_logprob"), F.when(has("words"), s("words")).otherwise(F.array().cast(f"array<{WORD}>")).alias("words"),
    )


def read_transcripts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return segments_of(parse_transcripts(read_files(spark, path)))


def parse_flags(files: DataFrame, asr_key: str = "asr_text", caption_key: str = "meet_text") -> DataFrame:
    """Spans of flags files: (recording_id, span_idx, start, end, caption_text, asr_text, reasons, suggestion)."""
    kind = f"struct<spans:array<struct<start:double,end:double,`{caption_key}`:string,`{asr_key}`:string,reasons:array<string>,suggestion:string>>>"
    out = files.withColumn("_d", F.from_json("raw", kind))
    out = out.withColumn("_s", F.when(F.col("_d.spans").isNull(), F.raise_error(F.concat(F.lit("not a flags file: "), "path")).cast(kind[len("struct<spans:") : -1])).otherwise(F.col("_d.spans")))
    x = lambda c: F.col("_x").getField(c)
    return out.select("recording_id", F.posexplode("_s").alias("span_idx", "_x")).select(
        "recording_id", "span_idx", x("start").alias("start"), x("end").alias("end"), F.coalesce(x(caption_key), F.lit("")).alias("caption_text"),
        F.coalesce(x(asr_key), F.lit("")).alias("asr_text"), F.coalesce(x("reasons"), F.array().cast("array<string>")).alias("reasons"), x("suggestion").alias("suggestion"),
    )


def read_flags(spark: SparkSession, path: str | list[str], asr_key: str = "asr_text") -> DataFrame:
    return parse_flags(read_files(spark, path), asr_key)


def _unix(raw: Column) -> Column:
    return F.replace(raw, F.lit("\r\n"), F.lit("\n"))


def parse_vtt(files: DataFrame) -> DataFrame:
    """Cues: (recording_id, cue_idx, start, end, text). Blocks are parted by an empty line; lines before the
    first timing line (an id) are dropped, blocks without one skipped. Times that are no number (a comma for
    the point, settings after the end) are null: wrong items, not wrong files."""
    blocks = files.select("recording_id", F.posexplode(F.split(_unix(F.col("raw")), "\n\n")).alias("_b", "block"))
    lines = F.filter(F.split("block", "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")) != "")
    timed = blocks.withColumn("_l", lines).withColumn("_t", F.array_position(F.transform("_l", lambda x: x.rlike(_TIMING)), F.lit(True)).cast("int")).where("_t > 0")
    line = F.element_at(F.col("_l"), F.col("_t"))
    cues = timed.select(
        "recording_id", "_b", parse_timestamp(F.substring_index(line, "-->", 1)).alias("start"), parse_timestamp(F.regexp_replace(line, r"^.*?-->", "")).alias("end"),
        F.array_join(F.expr("slice(_l, _t + 1, size(_l))"), "\n").alias("text"),
    )
    order = Window.partitionBy("recording_id").orderBy("_b")
    return cues.withColumn("cue_idx", F.row_number().over(order) - 1).select("recording_id", "cue_idx", "start", "end", "text")


def read_vtt(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_vtt(read_files(spark, path))


def vtt_headers(files: DataFrame) -> DataFrame:
    """(recording_id, header): the first block if it is a header, else the plain one."""
    first = F.regexp_replace(F.get(F.split(_unix(F.col("raw")), "\n\n", 2), F.lit(0)), r"(?U)^\s+|\s+$", "")
    return files.select("recording_id", F.when(F.startswith(first, F.lit("WEBVTT")), first).otherwise("WEBVTT").alias("header"))


def named_cues(cues: DataFrame) -> DataFrame:
    """Cues with `name`: what stands before the first ": " of the first line, "" without one."""
    first = F.substring_index("text", "\n", 1)
    return cues.withColumn("name", F.when(F.contains(first, F.lit(": ")), F.substring_index(first, ": ", 1)).otherwise(""))


def _yaml(path: str | Path, error: type[TalkgridError]) -> dict:
    path = Path(path)
    if not path.is_file():
        raise error(f"{path}: no such file")
    try:
        data = yaml.safe_load(path.read_text(encoding="utf-8"))
    except yaml.YAMLError as e:
        raise error(f"{path}: {e}") from e
    return data if isinstance(data, dict) else {}


def load_glossary(path: str | Path) -> list[Entry]:
    data = _yaml(path, DictionaryError)
    if not isinstance(data.get("terms"), list):
        raise DictionaryError(f"{path}: no list of terms")
    entries = []
    for t in data["terms"]:
        if not isinstance(t, dict) or not t.get("canonical"):
            raise DictionaryError(f"{path}: a term without canonical")
        heard = t.get("misheard") or []
        if not isinstance(heard, list):
            raise DictionaryError(f"{path}: misheard of {t['canonical']!r} is no list")
        entries.append(Entry(str(t["canonical"]), str(t.get("category") or "term"), t.get("note"), [str(m) for m in heard]))
    try:
        check(entries)
    except DictionaryError as e:
        raise DictionaryError(f"{path}: {e}") from e
    return entries


def load_glossaries(paths: list[str | Path]) -> list[Entry]:
    """Glossaries one after another, checked as one."""
    entries = [e for p in paths for e in load_glossary(p)]
    check(entries)
    return entries


def glossary_table(spark: SparkSession, entries: list[Entry]) -> DataFrame:
    return spark.createDataFrame([(i, e.canonical, e.category, e.note, list(e.misheard)) for i, e in enumerate(entries)], GLOSSARY)


def load_roster(path: str | Path) -> list[str]:
    return [str(x) for x in _yaml(path, TalkgridError).get("permanent") or []]


def load_corrections(path: str | Path) -> list[Correction]:
    out = []
    for c in _yaml(path, DictionaryError).get("corrections") or []:
        if not isinstance(c, dict) or not c.get("canonical") or not c.get("heard"):
            raise DictionaryError(f"{path}: a correction needs canonical and heard")
        out.append(Correction(str(c["canonical"]), str(c["heard"]), str(c.get("category") or "term")))
    return out


def resolve_file_list(path: str | Path) -> list[Path]:
    """Paths of a list file, relative to its folder; empty lines and # comments left out."""
    path = Path(path)
    lines = [x.strip() for x in path.read_text(encoding="utf-8").splitlines()]
    found = [x for x in lines if x and not x.startswith("#")]
    if not found:
        raise TalkgridError(f"{path}: the list is empty")
    return [Path(x) if Path(x).is_absolute() or x[1:2] == ":" else path.parent / x for x in found]


def check_inputs(paths: list[str | Path]) -> None:
    for p in map(Path, paths):
        if not p.exists():
            raise TalkgridError(f"{p}: no such file")
        if not p.is_file():
            raise TalkgridError(f"{p}: not a file")


def parse_choice(value: str, allowed: list[str]) -> str:
    """Exactly one of `allowed`, case and spaces included."""
    if value not in allowed:
        raise TalkgridError(f"{value!r} is not one of {', '.join(allowed)}")
    return value


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(folder, video, captions): each folder's first .mp4 and first .vtt that is not a named one, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    vtt = F.col("path").endswith(".vtt") & ~F.col("path").endswith(".named.vtt")
    return files.groupBy(folder.alias("folder")).agg(F.min(F.when(F.col("path").endswith(".mp4"), F.col("path"))).alias("video"), F.min(F.when(vtt, F.col("path"))).alias("captions"))


def require_pairing(fraction: float | None, least: float = 0.20) -> None:
    """Transcript and captions that hardly overlap are not of one recording."""
    if fraction is None or fraction < least:
        raise CrosscheckError(f"Only {100 * (fraction or 0):.0f}% of the captions meet a segment: are these of one recording?")
