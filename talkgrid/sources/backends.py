"""Factories for the media stages: each imports its library in the worker that builds it, once.

`named("module:function")` finds a factory of one's own.
"""

from __future__ import annotations

import importlib
import itertools
import os
import subprocess
from collections.abc import Callable, Sequence
from pathlib import Path

import numpy as np

from talkgrid.errors import DiarizeError, MediaLoadError, TalkgridError, TranscribeError
from talkgrid.functions.geometry import white_text
from talkgrid.functions.tiles import find_tiles
from talkgrid.sources.audio import RATE, load
from talkgrid.sources.media import Diarizer, Transcriber, frame_file

# Prompt tokens for hotwords; the gap, a share of the strip's width, after which text is no part of a name.
HOTWORD_TOKENS, NAME_GAP = 221, 0.12


def named(path: str) -> Callable:
    """The object at `module:name`."""
    module, _, name = path.partition(":")
    try:
        return getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError, ValueError) as e:
        raise TalkgridError(f"{path!r} is not module:name of a factory: {e}") from e


def _library(name: str, error: type[TalkgridError]):
    try:
        return importlib.import_module(name)
    except ImportError as e:
        raise error(f"{name} isn't installed") from e


def fitting(words: Sequence[str], count: Callable[[str], int], most: int = HOTWORD_TOKENS) -> str | None:
    """As many leading words, joined by spaces, as take `most` tokens; None if not even one does."""
    joined = itertools.accumulate(words, lambda a, b: f"{a} {b}")
    return max(itertools.takewhile(lambda x: count(f" {x}") <= most, joined), key=len, default=None)


def whisper(model: str = "large-v3", language: str = "auto", device: str = "auto") -> Callable[[], Transcriber]:
    """Recognition by faster-whisper, with word times."""

    class Backend:
        def __init__(self):
            library = _library("faster_whisper", TranscribeError)
            self.model = library.WhisperModel(model, device=device, compute_type="float16" if device == "cuda" else "int8")

        def transcribe(self, path: str, hotwords: Sequence[str] | None) -> list[dict]:
            prompt = fitting(hotwords or [], lambda x: len(self.model.hf_tokenizer.encode(x, add_special_tokens=False).ids))
            found, _ = self.model.transcribe(load(path), language=None if language == "auto" else language, hotwords=prompt, word_timestamps=True, vad_filter=True, beam_size=5)
            return [self._segment(s) for s in found]

        @staticmethod
        def _segment(s) -> dict:
            words = [{"w": w.word, "start": w.start, "end": w.end, "p": w.probability} for w in s.words or ()]
            return {"start": s.start, "end": s.end, "text": s.text.strip(), "confidence": s.avg_logprob, "avg_logprob": s.avg_logprob, "words": words}

    return Backend


def pyannote(speakers: int | None = None, device: str = "cpu", model: str = "pyannote/speaker-diarization-3.1") -> Callable[[], Diarizer]:
    """Speaker turns by pyannote; its model may ask for the token in HF_TOKEN."""

    class Backend:
        def __init__(self):
            self.torch = _library("torch", DiarizeError)
            self.find = _library("pyannote.audio", DiarizeError).Pipeline.from_pretrained(model, token=os.environ.get("HF_TOKEN"))
            if self.find is None:
                raise DiarizeError(f"{model} can't be loaded; is HF_TOKEN set?")
            if device not in ("auto", "cpu"):
                self.find.to(self.torch.device(device))

        def diarize(self, path: str) -> list[dict]:
            sound = {"waveform": self.torch.from_numpy(load(path)).unsqueeze(0), "sample_rate": RATE}
            found = self.find(sound, **({} if speakers is None else {"num_speakers": speakers}))
            found = getattr(found, "speaker_diarization", found)
            turns = ((t, who) for t, _, who in found.itertracks(yield_label=True)) if hasattr(found, "itertracks") else found
            return [{"start": t.start, "end": t.end, "speaker": who} for t, who in turns]

    return Backend


def read_picture(path: str | Path) -> np.ndarray:
    """A binary PPM file as a picture (blue, green, red)."""
    raw = Path(path).read_bytes()
    head, at = [], 0
    while len(head) < 4:
        end = next((i for i in range(at, len(raw)) if raw[i : i + 1].isspace()), len(raw))
        if end == len(raw):
            raise MediaLoadError(f"{path}: not a picture")
        if raw[at:end]:
            head.append(raw[at:end])
        at = end + 1
    if head[0] != b"P6" or head[3] != b"255" or not (head[1].isdigit() and head[2].isdigit()):
        raise MediaLoadError(f"{path}: not a picture of 8 bits a colour")
    wide, high = int(head[1]), int(head[2])
    if len(raw) - at < wide * high * 3:
        raise MediaLoadError(f"{path}: cut short")
    return np.frombuffer(raw, np.uint8, wide * high * 3, at).reshape(high, wide, 3)[..., ::-1]


def ffmpeg_frames(folder: str) -> Callable[[], Callable[[str, float], str | None]]:
    """Frames cut into `folder`, which all executors share; one that is there already is not cut again."""

    def cut(video: str, time: float) -> str | None:
        out = frame_file(folder, round(time * 1000)).with_suffix(".ppm")
        if out.is_file():
            return str(out)
        out.parent.mkdir(parents=True, exist_ok=True)
        part = out.with_suffix(f".{os.getpid()}.ppm")
        command = ["ffmpeg", "-nostdin", "-loglevel", "error", "-y", "-ss", f"{time:.3f}", "-i", video, "-frames:v", "1", "-pix_fmt", "rgb24", str(part)]
        try:
            subprocess.run(command, capture_output=True, check=False)
        except FileNotFoundError as e:
            raise MediaLoadError("frames can't be cut without ffmpeg") from e
        if not part.is_file():
            return None
        part.replace(out)
        return str(out)

    return lambda: cut


def tile_finder() -> Callable[[str], tuple[int, int, list[dict]]]:
    """Tiles by find_tiles(); faces too where OpenCV is installed, else a full frame is an `avatar`."""
    try:
        import cv2
    except ImportError:
        return lambda path: find_tiles(read_picture(path))
    known = cv2.CascadeClassifier(cv2.data.haarcascades + "haarcascade_frontalface_default.xml")
    return lambda path: find_tiles(read_picture(path), lambda grey: len(known.detectMultiScale(grey.astype(np.uint8), scaleFactor=1.1, minNeighbors=3, minSize=(20, 20))) > 0)


def leftmost(pieces: Sequence[tuple[float, float, str, float]], gap: float = NAME_GAP) -> list[tuple[float, float, str, float]]:
    """Pieces of text (left, right, text, confidence) from the left on, up to the first gap wider than `gap`."""
    rows = sorted(pieces, key=lambda p: p[0])
    reach = itertools.accumulate((p[1] for p in rows), max)
    return [rows[0], *(p for p, _ in itertools.takewhile(lambda x: x[0][0] - x[1] <= gap, zip(rows[1:], reach)))] if rows else []


def easyocr(languages: Sequence[str] = ("en",)) -> Callable[[], Callable[[str, dict], tuple[str, float] | None]]:
    """Names by EasyOCR: from the white letters of the strip, else from the strip as it is."""

    def make():
        reader = _library("easyocr", MediaLoadError).Reader(list(languages), gpu=False, verbose=False)

        def text_of(crop: np.ndarray) -> tuple[str, float] | None:
            found = [(min(x for x, _ in box) / crop.shape[1], max(x for x, _ in box) / crop.shape[1], text.strip(), float(sure)) for box, text, sure in reader.readtext(crop) if text.strip()]
            kept = leftmost(found)
            return (" ".join(p[2] for p in kept), float(np.mean([p[3] for p in kept]))) if kept else None

        def read(path: str, band: dict) -> tuple[str, float] | None:
            crop = strip_of(read_picture(path), band)
            return (text_of(white_text(crop)) or text_of(crop)) if crop.size else None

        return read

    return make


def strip_of(picture: np.ndarray, band: dict) -> np.ndarray:
    """The part of a picture in a normalised box."""
    high, wide = picture.shape[:2]
    x, y, w, h = round(band["x"] * wide), round(band["y"] * high), round(band["w"] * wide), round(band["h"] * high)
    return np.ascontiguousarray(picture[y : y + h, x : x + w])
