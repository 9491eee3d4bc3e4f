"""The plug-in surface for media: speech recognition, diarization, frames, OCR, tile detection, clips.

Backends are injected. Each is a factory that builds its model once for a Python worker, and a function over
one path; they run in mapInPandas over a table of paths, so a model loads once and paths spread over tasks.
Heavy libraries are imported inside the factory. Recognition and diarization are two stages, not one fused
call, as each may want the whole device.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgrid.functions.fuzzy import MATCH_FROM, match
from talkgrid.operators.votes import is_decided
from talkgrid.sources.readers import WORD

SEGMENTS = f"recording_id string, seg_idx int, start double, end double, text string, confidence double, avg_logprob double, words array<{WORD}>"
TURNS = "recording_id string, turn_idx int, start double, end double, speaker string"
FRAMES = "recording_id string, ms bigint, path string"
READINGS = "recording_id string, ms bigint, engine_idx int, text string, confidence double"
TILES = "recording_id string, ms bigint, width int, height int, tiles array<struct<kind:string,x:double,y:double,w:double,h:double,confidence:double>>"
DURATIONS = "recording_id string, file_idx int, filename string, duration double"
CLIPS = "recording_id string, span_idx int, clip string, made boolean"


class Transcriber(Protocol):
    def transcribe(self, path: str, hotwords: Sequence[str] | None) -> Sequence[dict]: ...


class Diarizer(Protocol):
    def diarize(self, path: str) -> Sequence[dict]: ...


def _run(paths: DataFrame, make: Callable[[], Callable[[pd.Series], Sequence[dict]]], schema: str) -> DataFrame:
    columns = T.StructType.fromDDL(schema).names

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = make()
        for batch in batches:
            rows = [r for row in batch.itertuples(index=False) for r in one(row)]
            yield pd.DataFrame(rows, columns=columns)

    return paths.mapInPandas(work, schema)


def transcribe(recordings: DataFrame, make: Callable[[], Transcriber], hotwords: Sequence[str] | None = None) -> DataFrame:
    """Recordings (recording_id, path) to segments in order."""

    def factory():
        backend = make()
        return lambda row: [{"confidence": 1.0, "avg_logprob": 0.0, "words": [], **s, "recording_id": row.recording_id, "seg_idx": i} for i, s in enumerate(backend.transcribe(row.path, hotwords))]

    return _run(recordings, factory, SEGMENTS)


def diarize(recordings: DataFrame, make: Callable[[], Diarizer]) -> DataFrame:
    """Recordings (recording_id, path) to speaker turns in order."""

    def factory():
        backend = make()
        return lambda row: [{**t, "recording_id": row.recording_id, "turn_idx": i} for i, t in enumerate(backend.diarize(row.path))]

    return _run(recordings, factory, TURNS)


def probe_durations(files: DataFrame, make: Callable[[], Callable[[str], float]]) -> DataFrame:
    """Files (recording_id, file_idx, filename, path) to their durations, for file_offsets()."""

    def factory():
        probe = make()
        return lambda row: [{"recording_id": row.recording_id, "file_idx": row.file_idx, "filename": row.filename, "duration": float(probe(row.path))}]

    return _run(files, factory, DURATIONS)


def sample_frames(times: DataFrame, make: Callable[[], Callable[[str, float], str | None]]) -> DataFrame:
    """Moments (recording_id, path, time, ms) to frame files, one for each millisecond; failed ones left out."""
    once = times.groupBy("recording_id", "path", "ms").agg(F.min("time").alias("time"))

    def factory():
        cut = make()

        def one(row):
            frame = cut(row.path, row.time)
            return [] if frame is None else [{"recording_id": row.recording_id, "ms": row.ms, "path": frame}]

        return one

    return _run(once, factory, FRAMES)


def detect_tiles(frames: DataFrame, make: Callable[[], Callable[[str], tuple[int, int, list[dict]]]]) -> DataFrame:
    """Frames (recording_id, ms, path) to frame sizes and the tiles found in them."""

    def factory():
        find = make()

        def one(row):
            width, height, tiles = find(row.path)
            return [{"recording_id": row.recording_id, "ms": row.ms, "width": width, "height": height, "tiles": tiles}]

        return one

    return _run(frames, factory, TILES)


def read_names(bands: DataFrame, engines: Sequence[Callable[[], Callable[[str, dict], tuple[str, float] | None]]]) -> DataFrame:
    """Name strips (recording_id, ms, path, band) to a reading of each engine that has one."""

    def factory():
        readers = [make() for make in engines]

        def one(row):
            got = [(i, read(row.path, row.band)) for i, read in enumerate(readers)]
            return [{"recording_id": row.recording_id, "ms": row.ms, "engine_idx": i, "text": x[0], "confidence": float(x[1])} for i, x in got if x is not None and x[0].strip()]

        return one

    return _run(bands, factory, READINGS)


class Match(NamedTuple):
    name: str
    score: float
    matched: bool


def frame_reader(read: Callable[[str], tuple[str, float] | None], candidates: list[str], least: float = MATCH_FROM) -> Callable[[str], Match | None]:
    """A function from a frame to its matched name, for early-stopping loops in one worker."""

    def one(path: str) -> Match | None:
        got = read(path)
        return Match(*match(got[0], candidates, least)) if got and got[0].strip() else None

    return one


def read_until_decided(paths: Sequence[str], reader: Callable[[str], Match | None]) -> list[Match | None]:
    """Readings in order, until a matched name holds more than half of the planned frames."""
    out: list[Match | None] = []
    for p in paths:
        out.append(reader(p))
        if is_decided(out, len(paths)):
            break
    return out


def clip_command(video: str, start: float, seconds: float, out: str) -> list[str]:
    """ffmpeg arguments for a clip to review in a browser: one picture and one mono sound track where there are
    any, at most 854 pixels wide, playable from its first bytes on."""
    source = ["-ss", f"{max(0.0, start):.3f}", "-t", f"{seconds:.3f}", "-i", video]
    picture = ["-map", "0:v:0?", "-vf", "scale=w='min(854,iw)':h=-2", "-pix_fmt", "yuv420p", "-c:v", "libx264", "-crf", "30"]
    sound = ["-map", "0:a:0?", "-ac", "1", "-c:a", "aac", "-b:a", "64k"]
    return ["ffmpeg", "-y", *source, *picture, *sound, "-movflags", "faststart", "-nostdin", "-loglevel", "error", out]


def run_command(command: list[str]) -> bool:
    """Run a command whose last argument is the file it writes. False if it isn't there, fails or writes nothing."""
    if shutil.which(command[0]) is None:
        return False
    done = subprocess.run(command, stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, check=False)
    written = Path(command[-1])
    return done.returncode == 0 and written.is_file() and os.path.getsize(written) > 0


def cut_clips(windows: DataFrame, out_dir: str, make: Callable[[], Callable[[list[str]], bool]] = lambda: run_command) -> DataFrame:
    """Spans with clip windows and `video` to clips; a clip that can't be made is marked, never an error."""

    def factory():
        run = make()

        def one(row):
            clip = f"{out_dir}/{row.recording_id}-{row.span_idx:03d}.mp4"
            return [{"recording_id": row.recording_id, "span_idx": row.span_idx, "clip": clip, "made": bool(run(clip_command(row.video, row.clip_start, row.clip_seconds, clip)))}]

        return one

    return _run(windows, factory, CLIPS)


def frame_cache(video: str | Path, root: str | Path | None = None) -> Path:
    """The folder under `root`, which on a cluster all executors must share (without one, this machine's), for a video's frames: its stem, and a hash of its whole path."""
    video = Path(video)
    return Path(root or tempfile.gettempdir()) / "talkgrid-frames" / f"{video.stem}-{hashlib.sha1(str(video.resolve()).encode()).hexdigest()[:8]}"


def frame_file(folder: str | Path, ms: int) -> Path:
    return Path(folder) / f"t_{ms:09d}.jpg"


def output_paths(inputs: list[Path], tag: str, explicit: Path | None = None, listed: Path | None = None) -> tuple[Path, Path]:
    """The transcript's text and JSON paths: an explicit one, else named after the list file, the only input, or
    the first input with `_combined`."""
    if explicit is not None:
        text = explicit
    elif listed is not None:
        text = listed.with_name(f"{listed.stem}.{tag}.txt")
    else:
        text = inputs[0].with_name(f"{inputs[0].stem}{'' if len(inputs) == 1 else '_combined'}.{tag}.txt")
    return text, text.with_name(f"{text.stem.removesuffix(f'.{tag}')}.{tag}.json")


def speed(audio_seconds: float, elapsed: float, total: float, least: float = 10.0) -> tuple[float, float | None]:
    """Progress as a share, and audio seconds a second once there is enough audio to tell."""
    progress = min(audio_seconds / total, 1.0) if total > 0 else 0.0
    return progress, audio_seconds / elapsed if audio_seconds >= least and elapsed > 0 else None
