"""Audio as mono samples at one rate: WAV by the standard library, everything else through ffmpeg."""

from __future__ import annotations

import math
import subprocess
import tempfile
import wave
from collections.abc import Sequence
from pathlib import Path

import numpy as np

from talkgrid.errors import MediaLoadError

#: Samples a second that speech models take.
RATE = 16_000
#: Zero crossings of the resampling filter on each side.
CROSSINGS = 24
#: Output samples that are resampled at once.
STEP = 1 << 14


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Samples at another rate, band-limited by a windowed sinc; ceil(n * to / rate) of them."""
    if rate == to or not len(samples):
        return samples
    cut = min(1.0, to / rate)
    reach = math.ceil(CROSSINGS / cut)
    up, down = to // math.gcd(rate, to), rate // math.gcd(rate, to)
    near = np.arange(-reach + 1, reach + 1)
    away = np.arange(up)[:, None] / up - near  # an output sample lies at one of `up` places between two inputs
    weights = cut * np.sinc(cut * away) * np.cos(np.clip(away / (2 * reach), -0.5, 0.5) * np.pi) ** 2
    padded = np.pad(np.asarray(samples, np.float64), reach + 1)
    out = np.empty(math.ceil(len(samples) * up / down))
    for lo in range(0, len(out), STEP):
        whole, place = np.divmod(np.arange(lo, min(lo + STEP, len(out))) * down, up)
        out[lo : lo + len(whole)] = np.einsum("ij,ij->i", padded[whole[:, None] + near + reach + 1], weights[place])
    return out


def _pcm(raw: bytes, width: int) -> np.ndarray:
    """Integer samples of 1 (unsigned), 2, 3 or 4 bytes, as numbers from -1 to 1."""
    if width == 1:
        return np.frombuffer(raw, np.uint8) / 128.0 - 1
    four = np.zeros((len(raw) // width, 4), np.uint8)
    four[:, 4 - width :] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return four.view("<i4")[:, 0] / 2.0**31


def _read_wav(path: Path, seconds: float | None) -> tuple[np.ndarray, int]:
    with wave.open(str(path), "rb") as f:
        rate, channels, width = f.getframerate(), f.getnchannels(), f.getsampwidth()
        raw = f.readframes(f.getnframes() if seconds is None else min(f.getnframes(), math.ceil(seconds * rate) + rate))
    whole = len(raw) // (channels * width) * channels * width
    return _pcm(raw[:whole], width).reshape(-1, channels).mean(axis=1), rate


def _convert(path: Path, out: Path, rate: int, seconds: float | None) -> None:
    length = [] if seconds is None else ["-t", f"{seconds:.3f}"]
    try:
        done = subprocess.run(["ffmpeg", "-nostdin", "-loglevel", "error", "-y", "-i", str(path), *length, "-map", "0:a:0", "-ac", "1", "-ar", str(rate), str(out)], capture_output=True, text=True, check=False)
    except FileNotFoundError as e:
        raise MediaLoadError(f"{path}: only WAV files can be read without ffmpeg") from e
    if done.returncode:
        raise MediaLoadError(f"{path}: {done.stderr.strip()}")


def load(path: str | Path, seconds: float | None = None, rate: int = RATE) -> np.ndarray:
    """A file's sound: channels averaged, at `rate`, float32, its first `seconds` if given."""
    path = Path(path)
    if not path.is_file():
        raise MediaLoadError(f"{path}: no such file")
    try:
        if path.suffix.lower() == ".wav":
            samples, own = _read_wav(path, seconds)
        else:
            with tempfile.TemporaryDirectory() as folder:
                _convert(path, Path(folder) / "sound.wav", rate, seconds)
                samples, own = _read_wav(Path(folder) / "sound.wav", None)
    except (wave.Error, EOFError, OSError) as e:
        raise MediaLoadError(f"{path}: {e}") from e
    return resample(samples, own, rate)[: None if seconds is None else int(seconds * rate)].astype(np.float32)


def join(paths: Sequence[str | Path], seconds: float | None = None, rate: int = RATE) -> tuple[np.ndarray, list[float]]:
    """The files' sound one after another, `seconds` of it in all if given, and the length of each file in it."""
    if not paths:
        raise MediaLoadError("no files")
    for p in map(Path, paths):
        if not p.is_file():
            raise MediaLoadError(f"{p}: no such file")
    parts, left = [], seconds
    for p in paths:
        parts.append(load(p, left, rate))
        left = None if left is None else max(0.0, left - len(parts[-1]) / rate)
    return np.concatenate(parts), [len(x) / rate for x in parts]


def write_wav(samples: np.ndarray, path: str | Path, rate: int = RATE) -> None:
    """Mono samples as a 16-bit WAV file."""
    with wave.open(str(path), "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(rate)
        f.writeframes(np.rint(np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
