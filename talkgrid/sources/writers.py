"""Writers: transcript and flags JSON, transcript text, named captions, annotations, review page, glossary.

Each document is built as one string a recording, in expressions, and written by Spark; a recording is a
bounded unit. The review page and YAML edits are small and made on the driver.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Sequence
from pathlib import Path
from typing import NamedTuple

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrid.functions.text import clock, format_timestamp
from talkgrid.operators.glossary import CATEGORIES, Entry, Merged
from talkgrid.operators.spans import name_blocks, speaker_blocks, speaker_labels

KEEP_NULLS = {"ignoreNullFields": "false"}


def _per_recording(df: DataFrame, order: str, fields: list, key: str = "recording_id") -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("x"))))
    return df.groupBy(key).agg(F.transform(rows, lambda r: r["x"]).alias("_rows"))


def transcript_json(segments: DataFrame, heads: DataFrame) -> DataFrame:
    """(recording_id, document): segments with speakers, under each recording's language, model and
    hotwords_from (heads)."""
    fields = ["start", "end", "speaker", "text", "avg_logprob", "words"]
    body = _per_recording(segments, "seg_idx", fields)
    doc = F.to_json(F.struct("language", "model", "hotwords_from", F.coalesce("_rows", F.array().cast(body.schema["_rows"].dataType)).alias("segments")), KEEP_NULLS)
    return heads.join(body, "recording_id", "left").select("recording_id", doc.alias("document"))


def flags_json(spans: DataFrame, asr_key: str = "asr_text", caption_key: str = "meet_text") -> DataFrame:
    """(recording_id, document): spans in order, a null suggestion written as null."""
    fields = ["start", "end", F.col("caption_text").alias(caption_key), F.col("asr_text").alias(asr_key), "reasons", "suggestion"]
    return _per_recording(spans, "span_idx", fields).select("recording_id", F.to_json(F.struct(F.col("_rows").alias("spans")), KEEP_NULLS).alias("document"))


def indented(document: str) -> str:
    """A JSON document as it is stored: two spaces a level, no escapes beyond JSON's own."""
    return json.dumps(json.loads(document), ensure_ascii=False, indent=2)


def transcript_text(segments: DataFrame, with_files: bool = False) -> DataFrame:
    """(recording_id, document): `[HH:MM:SS] Speaker n:` blocks with an empty line between. With files (file_idx,
    filename, and times within the file, from file_of()), a `--- filename ---` line stands before each file's
    blocks if the recording has several files."""
    keys = ["recording_id", "file_idx", "filename"] if with_files else ["recording_id"]
    blocks = speaker_blocks(segments, keys).join(speaker_labels(segments), ["recording_id", "speaker"])
    block = F.concat(clock(F.col("start")), F.lit(" "), F.col("label"), F.lit(":\n"), F.col("text"))
    joined = lambda rows: F.array_join(F.transform(F.sort_array(F.collect_list(rows)), lambda r: r["t"]), "\n\n")
    per_file = blocks.groupBy(*keys).agg(joined(F.struct("run", block.alias("t"))).alias("t"))
    if not with_files:
        return per_file.select("recording_id", F.col("t").alias("document"))
    part = F.concat(F.lit("--- "), F.col("filename"), F.lit(" ---\n\n"), F.col("t"))
    several = per_file.join(segments.groupBy("recording_id").agg(F.countDistinct("file_idx").alias("_n")), "recording_id")
    return several.groupBy("recording_id").agg(joined(F.struct("file_idx", F.when(F.col("_n") > 1, part).otherwise(F.col("t")).alias("t"))).alias("document"))


def named_vtt(cues: DataFrame, headers: DataFrame) -> DataFrame:
    """(recording_id, document): cues (cue_idx, start, end, text, name) as WebVTT, each first line after its name."""
    first, rest = F.substring_index("text", "\n", 1), F.when(F.contains(F.col("text"), F.lit("\n")), F.concat(F.lit("\n"), F.regexp_replace("text", r"^[^\n]*\n", ""))).otherwise("")
    head = F.when(first != "", F.regexp_replace(F.concat(F.col("name"), F.lit(": "), first), r"(?U)\s+$", "")).otherwise(F.concat(F.col("name"), F.lit(":")))
    block = F.concat(format_timestamp(F.col("start")), F.lit(" --> "), format_timestamp(F.col("end")), F.lit("\n"), head, rest, F.lit("\n"))
    rows = F.sort_array(F.collect_list(F.struct("cue_idx", block.alias("t"))))
    body = cues.groupBy("recording_id").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n").alias("_t"))
    whole = F.concat(F.regexp_replace(F.concat(F.col("header"), F.lit("\n\n"), F.coalesce("_t", F.lit(""))), r"(?U)\s+$", ""), F.lit("\n"))
    return headers.join(body, "recording_id", "left").select("recording_id", whole.alias("document"))


def annotation_text(cues: DataFrame) -> DataFrame:
    """(recording_id, document): `[HH:MM:SS] Name:` blocks of neighbouring cues of a name."""
    block = F.concat(clock(F.col("start")), F.lit(" "), F.col("name"), F.lit(":\n"), F.col("text"))
    rows = F.sort_array(F.collect_list(F.struct("run", block.alias("t"))))
    return name_blocks(cues).groupBy("recording_id").agg(F.concat(F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n"), F.lit("\n")).alias("document"))


def write_documents(documents: DataFrame, path: str) -> None:
    """One folder a recording, one text file in it."""
    documents.select("recording_id", F.col("document").alias("value")).write.mode("overwrite").partitionBy("recording_id").text(path)


class ReviewRow(NamedTuple):
    index: int
    clip: str | None
    timestamp: str
    speaker: str
    reasons: Sequence[str]
    caption_html: str
    asr_html: str
    suggestion: str | None


_STYLE = "body{font:15px/1.5 sans-serif;margin:2rem auto;max-width:70rem}section{display:grid;grid-template-columns:22rem 1fr;gap:1rem;padding:1rem 0;border-top:1px solid #ccc}video{width:100%}mark{background:#ffd54d}.tag{background:#eee;border-radius:3px;padding:0 .4em}"
_SCRIPT = """
const quoted = s => '"' + s.replaceAll('\\\\', '\\\\\\\\').replaceAll('"', '\\\\"') + '"';
document.getElementById('export').onclick = () => {
  const rows = [...document.querySelectorAll('section')].filter(r => r.querySelector('.add').checked);
  const lines = rows.map(r => ['canonical', 'heard', 'category'].map((k, i) => (i ? '    ' : '  - ') + k + ': ' + quoted(r.querySelector('.' + k).value)).join('\\n'));
  const link = document.createElement('a');
  link.href = URL.createObjectURL(new Blob(['corrections:\\n' + lines.join('\\n') + '\\n'], {type: 'text/yaml'}));
  link.download = 'corrections.yaml';
  link.click();
};
"""


def review_row(row: ReviewRow) -> str:
    e = html.escape
    clip = f'<video controls preload="none" src="{e(row.clip)}"></video>' if row.clip else "<p>clip unavailable</p>"
    tags = " ".join(f'<span class="tag">{e(r)}</span>' for r in row.reasons)
    who = f" &middot; {e(row.speaker)}" if row.speaker else ""
    heard = row.asr_html.replace("<mark>", "").replace("</mark>", "")
    kinds = "".join(f"<option{' selected' if c == 'term' else ''}>{c}</option>" for c in CATEGORIES)
    return (
        f'<section data-row="{row.index}"><div>{clip}</div><div><p><b>{e(row.timestamp)}</b>{who} {tags}</p><p>captions: {row.caption_html or "&mdash;"}</p><p>transcript: {row.asr_html or "&mdash;"}</p>'
        f'<p><input class="canonical" placeholder="canonical" value="{e(row.suggestion or "")}"> <input class="heard" placeholder="heard as" value="{heard}"> <select class="category">{kinds}</select>'
        f' <label><input type="checkbox" class="add"> add to glossary</label></p></div></section>'
    )


def review_page(rows: Sequence[ReviewRow], title: str) -> str:
    """A page on its own that shows spans and exports corrections."""
    body = "\n".join(map(review_row, rows))
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{_STYLE}</style></head><body><h1>{html.escape(title)}</h1><button id="export">Export corrections</button>\n{body}\n<script>{_SCRIPT}</script></body></html>\n'


def _scalar(value: str) -> str:
    return json.dumps(value, ensure_ascii=False)


def _heard_at(block: list[str]) -> tuple[int, int] | None:
    """Where an entry's `misheard` key stands, and its indentation."""
    for i, line in enumerate(block):
        m = re.match(r"(\s*(?:- )?)misheard:", line)
        if m:
            return i, len(m[1])
    return None


def write_back(path: str | Path, before: Sequence[Entry], after: Sequence[Entry], done: Merged) -> None:
    """Bring a glossary file up to date with comments left in place: new mishearings become lines under their
    entry, new entries lines at the end. A file laid out otherwise is written anew."""
    if not done.added_entries and not done.added_misheard:
        return
    path = Path(path)
    lines = path.read_text(encoding="utf-8").rstrip("\n").split("\n")
    starts = [i for i, x in enumerate(lines) if re.match(r"\s*- ", x) and not re.match(r"\s*- (?!canonical|category|note|misheard)\S", x)]
    want = [{"canonical": e.canonical, "category": e.category, **({"note": e.note} if e.note is not None else {}), "misheard": e.misheard} for e in after]
    if len(starts) == len(before):
        indent = re.match(r"\s*", lines[starts[0]])[0] if starts else "  "
        fresh = {e.canonical for e in after[len(before) :]}
        for n in range(len(before) - 1, -1, -1):
            own = [h for c, h in done.added_misheard if c == before[n].canonical]
            if not own:
                continue
            stop = starts[n + 1] if n + 1 < len(starts) else len(lines)
            block = lines[starts[n] : stop]
            at = _heard_at(block)
            if at is None:
                last = max(i for i, x in enumerate(block) if x.strip() and not x.strip().startswith("#"))
                block[last + 1 : last + 1] = [f"{indent}  misheard:", *(f"{indent}    - {_scalar(h)}" for h in own)]
            elif re.search(r"misheard:\s*\[.*\]", block[at[0]]):
                block[at[0]] = re.sub(r"\]", lambda m, old=block[at[0]]: ("" if re.search(r"\[\s*\]", old) else ", ") + ", ".join(map(_scalar, own)) + "]", block[at[0]], count=1)
            else:
                last = at[0]
                while last + 1 < len(block) and (re.match(r"\s*- ", block[last + 1]) or block[last + 1].strip().startswith("#") or not block[last + 1].strip()):
                    last += 1
                while not block[last].strip() or block[last].strip().startswith("#"):
                    last -= 1
                pad = re.match(r"\s*", block[last])[0] if last > at[0] else indent + "    "
                block[last + 1 : last + 1] = [f"{pad}- {_scalar(h)}" for h in own]
            lines[starts[n] : stop] = block
        for e in after[len(before) :]:
            lines += [f"{indent}- canonical: {_scalar(e.canonical)}", f"{indent}  category: {_scalar(e.category)}", f"{indent}  misheard:", *(f"{indent}    - {_scalar(h)}" for h in e.misheard)] if e.canonical in fresh else []
        text = "\n".join(lines) + "\n"
        found = (yaml.safe_load(text) or {}).get("terms")
        same = [{k: v for k, v in t.items() if k in ("canonical", "category", "note", "misheard")} | {"misheard": t.get("misheard") or []} for t in found or []] == want
        if same:
            path.write_text(text, encoding="utf-8")
            return
    path.write_text(yaml.safe_dump({"terms": want}, allow_unicode=True, sort_keys=False), encoding="utf-8")
