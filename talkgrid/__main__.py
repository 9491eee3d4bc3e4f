"""python -m talkgrid COMMAND: transcribe, nametag, crosscheck, review and glossary-merge over files; sessions as configured."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from talkgrid.errors import TalkgridError
from talkgrid.operators.ranking import reason_counts
from talkgrid.plans.crosscheck import crosscheck
from talkgrid.plans.glossary import merge_file
from talkgrid.plans.nametag import meeting_files, name_meeting
from talkgrid.plans.review import page, review_rows
from talkgrid.plans.transcribe import transcribe_files
from talkgrid.sources import backends, media, readers, writers

# What may be chosen.
MODELS, DEVICES = ["tiny", "base", "small", "medium", "large-v3"], ["auto", "cuda", "mps", "cpu"]


def _transcribe(a: argparse.Namespace) -> None:
    if bool(a.inputs) == bool(a.from_file):
        raise TalkgridError("name input files or --from-file, one of both")
    listed = Path(a.from_file) if a.from_file else None
    if listed:
        readers.check_inputs([listed])
    inputs = readers.resolve_file_list(listed) if listed else [Path(p) for p in a.inputs]
    readers.check_inputs(inputs)
    model, device = readers.parse_choice(a.model, MODELS), readers.parse_choice(a.device, DEVICES)
    recognizer = backends.named(a.recognizer) if a.recognizer else backends.whisper(model, a.language, device)
    diarizer = backends.named(a.diarizer) if a.diarizer else backends.pyannote(a.speakers, device)
    text_path, json_path = media.output_paths(inputs, "talkgrid", Path(a.output) if a.output else None, listed)
    text, document = transcribe_files(SparkSession.builder.getOrCreate(), inputs, recognizer, diarizer, a.language, model, a.glossary, a.duration, a.work)
    text_path.write_text(text, encoding="utf-8")
    json_path.write_text(document, encoding="utf-8")
    print(f"{text_path}\n{json_path}")


def _nametag(a: argparse.Namespace) -> None:
    video, captions, out = meeting_files(*(Path(p) if p else None for p in (a.folder, a.video, a.vtt)))
    candidates = [*(readers.load_roster(a.roster) if a.roster else []), *a.guest]
    cache = media.frame_cache(video, a.work)
    frames = backends.named(a.frames) if a.frames else backends.ffmpeg_frames(str(cache))
    tiles = backends.named(a.tiles) if a.tiles else backends.tile_finder
    engines = [backends.named(e) for e in a.engine] or [backends.easyocr()]
    vtt, text, doubtful = name_meeting(SparkSession.builder.getOrCreate(), video, captions, candidates, frames, tiles, engines)
    for ending, document in ((".named.vtt", vtt), (".named.txt", text)):
        (out / f"{video.stem}{ending}").write_text(document, encoding="utf-8")
        print(out / f"{video.stem}{ending}")
    if doubtful:
        print(f"{len(doubtful)} cues to look at; their frames are in {cache}")
    elif not a.keep_cache:
        for frame in cache.glob("t_*.ppm"):
            frame.unlink()


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="talkgrid")
    commands = top.add_subparsers(dest="command", required=True)
    c = commands.add_parser("crosscheck", help="flag segments that captions, confidence or a glossary put in doubt")
    c.add_argument("transcripts"), c.add_argument("--captions"), c.add_argument("--glossary", action="append", default=[]), c.add_argument("--out", required=True)
    r = commands.add_parser("review", help="a page to review one recording's flags")
    r.add_argument("flags"), r.add_argument("recording"), r.add_argument("--names"), r.add_argument("--limit", type=int), r.add_argument("--out", required=True)
    g = commands.add_parser("glossary-merge", help="add corrections to a glossary")
    g.add_argument("glossary"), g.add_argument("corrections")
    t = commands.add_parser("transcribe", help="recordings to text and JSON with speakers; several files are heard as one")
    t.add_argument("inputs", nargs="*"), t.add_argument("--from-file", "-f"), t.add_argument("--output", "-o"), t.add_argument("--glossary", action="append", default=[])
    t.add_argument("--language", "-l", default="auto"), t.add_argument("--model", "-m", default="large-v3"), t.add_argument("--device", default="auto")
    t.add_argument("--speakers", "-s", type=int), t.add_argument("--duration", type=float, help="only the first so many seconds")
    t.add_argument("--recognizer", help="module:factory"), t.add_argument("--diarizer", help="module:factory")
    n = commands.add_parser("nametag", help="who speaks each caption, read off the video")
    n.add_argument("folder", nargs="?"), n.add_argument("--video"), n.add_argument("--vtt"), n.add_argument("--guest", "-g", action="append", default=[]), n.add_argument("--roster"), n.add_argument("--keep-cache", action="store_true")
    n.add_argument("--frames", help="module:factory"), n.add_argument("--tiles", help="module:factory"), n.add_argument("--engine", action="append", default=[], help="module:factory")
    for x in (t, n):
        x.add_argument("--work", help="a folder for joined sound and frames; on a cluster, one that all executors share")
    a = top.parse_args(argv)
    try:
        if a.command in ("transcribe", "nametag"):
            {"transcribe": _transcribe, "nametag": _nametag}[a.command](a)
            return 0
        if a.command == "glossary-merge":
            done = merge_file(a.glossary, a.corrections)
            print(f"{len(done.added_entries)} new entries, {len(done.added_misheard)} new mishearings, {done.unchanged} unchanged")
            return 0
        spark = SparkSession.builder.getOrCreate()
        if a.command == "crosscheck":
            cues = readers.read_vtt(spark, a.captions) if a.captions else None
            glossary = readers.glossary_table(spark, readers.load_glossaries(a.glossary)) if a.glossary else None
            spans = crosscheck(readers.read_transcripts(spark, a.transcripts), cues, glossary)
            writers.write_documents(writers.flags_json(spans), a.out)
            for row in reason_counts(spans).collect():
                print(f"{row['reason']}: {row['n']}")
        else:
            named = readers.named_cues(readers.read_vtt(spark, a.names)) if a.names else None
            text = page(review_rows(readers.read_flags(spark, a.flags), named, limit=a.limit), a.recording, a.recording)
            with open(a.out, "w", encoding="utf-8") as f:
                f.write(text)
    except TalkgridError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
