"""Tiles on drawn frames, audio, and the commands transcribe and nametag with backends of their own."""

import sys
import types
import wave

import numpy as np
import pytest

from talkgrid.__main__ import main
from talkgrid.errors import MediaLoadError, TalkgridError, TranscribeError
from talkgrid.functions import tiles
from talkgrid.sources import audio, backends

HIGH, WIDE = 540, 960


def page(right: float, level: int = 205, high: int = HIGH, wide: int = WIDE) -> np.ndarray:
    """A page with lines of text on the left, black on the right."""
    rng, frame = np.random.default_rng(5), np.zeros((high, wide, 3), np.uint8)
    frame[:, : int(wide * right)] = level
    for _ in range(240):
        y, x = rng.integers(10, high - 10), rng.integers(5, int(wide * right) - 30)
        frame[y : y + 2, x : x + 25] = 25 if level > 100 else 200
    return frame


def noise(frame: np.ndarray, x: int, y: int, w: int, h: int, seed: int = 1) -> np.ndarray:
    frame[y : y + h, x : x + w] = np.random.default_rng(seed).integers(45, 200, (h, w, 3))
    return frame


def disk(frame: np.ndarray, x: int, y: int, radius: int) -> np.ndarray:
    yy, xx = np.ogrid[: frame.shape[0], : frame.shape[1]]
    frame[(yy - y) ** 2 + (xx - x) ** 2 <= radius * radius] = (40, 100, 170)
    return frame


def near(found: dict, box: tuple[int, int, int, int], by: int) -> bool:
    return all(abs(found[k] * n - v) <= by for k, n, v in zip("xywh", (WIDE, HIGH, WIDE, HIGH), box, strict=True))


@pytest.mark.parametrize("right, level, by", [(0.78, 205, 14), (0.62, 245, 14), (0.70, 20, 14)])
def test_camera_beside_a_page(right, level, by):
    box = (int(WIDE * 0.82), 200, 150, 140)
    wide, high, found = tiles.find_tiles(noise(page(right, level), *box))
    assert (wide, high, len(found)) == (WIDE, HIGH, 1) and found[0]["kind"] == "camera" and found[0]["confidence"] == tiles.PIP_SURE
    assert near(found[0], box, by)


def test_camera_that_touches_the_page():
    frame = noise(page(0.85), int(WIDE * 0.85), 180, WIDE - int(WIDE * 0.85), 160)
    (found,) = tiles.find_tiles(frame)[2]
    assert found["kind"] == "camera" and abs(found["x"] - 0.85) < 0.02 and found["w"] < tiles.WIDEST


def test_avatars():
    dim = page(0.70)
    dim[180:340, int(WIDE * 0.75) : WIDE - 10] = 20
    (found,) = tiles.find_tiles(disk(dim, int(WIDE * 0.87), 260, 24))[2]
    assert found["kind"] == "avatar" and near(found, (720, 180, 230, 160), 14)
    (found,) = tiles.find_tiles(disk(page(0.70), int(WIDE * 0.9), 260, 24))[2]
    assert found["kind"] == "avatar" and found["x"] > 0.55


def test_frames_without_a_shared_screen():
    full = np.random.default_rng(2).integers(40, 200, (HIGH, WIDE, 3), np.uint8)
    assert tiles.find_tiles(full)[2] == [{"kind": "avatar", "x": 0, "y": 0, "w": 1, "h": 1, "confidence": tiles.PLAIN_SURE}]
    assert tiles.find_tiles(full, lambda grey: True)[2][0]["kind"] == "camera"
    (found,) = tiles.find_tiles(noise(np.zeros((HIGH, WIDE, 3), np.uint8), 280, 0, 400, HIGH))[2]
    assert near(found, (280, 0, 400, HIGH), 1)
    assert tiles.find_tiles(np.zeros((HIGH, WIDE, 3), np.uint8))[2] == []
    assert tiles.find_tiles(np.full((10, 10, 3), 3, np.uint8))[2] == []
    lone = disk(np.zeros((HIGH, WIDE, 3), np.uint8), WIDE // 2, HIGH // 2, 120)
    assert near(tiles.find_tiles(lone)[2][0], (360, 150, 241, 241), 1)  # black on both sides: the lit area


def test_feed_box():
    grey = np.full((100, 200), 17.0)
    grey[:10], grey[90:], grey[20:80, 60:150], grey[80:90, 60:150] = 0, 0, 120, 12
    assert tiles.feed_box(grey, (10, 0, 180, 100)) == (60, 10, 90, 80)
    assert tiles.feed_box(np.zeros((9, 9)), (1, 2, 3, 4)) == (1, 2, 3, 4) and tiles.feed_box(grey, (0, 0, 0, 5)) == (0, 0, 0, 5)


def test_last_run():
    def plain(mask, gap):
        at = [i for i, x in enumerate(mask) if x]
        if not at:
            return None
        first = at[-1]
        for i in reversed(at):
            if first - i - 1 >= gap:
                break
            first = i
        return first, at[-1]

    rng = np.random.default_rng(3)
    for _ in range(300):
        mask, gap = rng.random(rng.integers(0, 30)) < rng.random(), int(rng.integers(1, 6))
        assert tiles.last_run(mask, gap) == plain(mask, gap)


def tone(path, seconds: float, rate: int, channels: int = 1, hertz: float = 440, width: int = 2):
    x = 0.5 * np.sin(2 * np.pi * hertz * np.arange(int(seconds * rate)) / rate)
    raw = np.repeat(np.rint(x * (2 ** (8 * width - 1) - 1)).astype("<i4"), channels)
    data = (raw + 128).astype(np.uint8).tobytes() if width == 1 else raw.view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels), f.setsampwidth(width), f.setframerate(rate)
        f.writeframes(data)
    return path


@pytest.mark.parametrize("rate, channels, width", [(16_000, 1, 2), (48_000, 2, 3), (44_100, 1, 4), (8_000, 2, 1)])
def test_audio_is_mono_at_one_rate(tmp_path, rate, channels, width):
    got = audio.load(tone(tmp_path / "a.wav", 1.5, rate, channels, width=width))
    want = 0.5 * np.sin(2 * np.pi * 440 * np.arange(len(got)) / audio.RATE)
    assert got.dtype == np.float32 and len(got) == 24_000 and np.abs(got - want)[500:-500].max() < 0.02


def test_what_lies_above_the_new_rate_goes(tmp_path):
    assert np.abs(audio.load(tone(tmp_path / "a.wav", 1, 48_000, hertz=15_000))[500:-500]).max() < 0.01


def test_joined_audio(tmp_path):
    a, b = tone(tmp_path / "a.wav", 2, 16_000), tone(tmp_path / "b.wav", 1, 8_000)
    samples, lengths = audio.join([a, b])
    assert len(samples) == 48_000 and lengths == [2, 1] and np.array_equal(samples[:32_000], audio.load(a))
    assert audio.join([a, b], 2.5)[1] == [2, 0.5] and audio.join([a, b], 1)[1] == [1, 0] and len(audio.load(a, 0.25)) == 4_000
    audio.write_wav(samples, tmp_path / "c.wav")
    assert np.abs(audio.load(tmp_path / "c.wav") - samples).max() < 1e-4
    (tmp_path / "d.wav").write_bytes(b"no sound")
    for bad in ([], [a, tmp_path / "none.wav"], [tmp_path / "d.wav"], [tmp_path]):
        with pytest.raises(MediaLoadError):
            audio.join(bad)


def test_pictures_and_pieces(tmp_path):
    rgb = np.random.default_rng(4).integers(0, 256, (3, 5, 3), np.uint8)
    (tmp_path / "a.ppm").write_bytes(b"P6\n5 3\n255\n" + rgb.tobytes())
    picture = backends.read_picture(tmp_path / "a.ppm")
    assert np.array_equal(picture, rgb[..., ::-1]) and backends.strip_of(picture, {"x": 0.2, "y": 0, "w": 0.4, "h": 1}).shape == (3, 2, 3)
    for raw in (b"", b"P5 1 1 255 x", b"P6 9 9 255 x"):
        (tmp_path / "b.ppm").write_bytes(raw)
        with pytest.raises(MediaLoadError):
            backends.read_picture(tmp_path / "b.ppm")
    assert backends.leftmost([]) == [] and [p[2] for p in backends.leftmost([(0.5, 0.6, "c", 1.0), (0.0, 0.2, "a", 1.0), (0.25, 0.3, "b", 1.0)])] == ["a", "b"]
    assert backends.fitting(["ab", "c", "def"], len, 6) == "ab c" and backends.fitting(["abcdef"], len, 3) is None and backends.fitting([], len) is None


def test_backends_of_libraries(tmp_path, monkeypatch):
    path = tone(tmp_path / "a.wav", 1, 16_000)
    space = types.SimpleNamespace
    heard, word = {}, space(word=" hi", start=0.0, end=0.4, probability=0.9)

    class Model:
        hf_tokenizer = space(encode=lambda x, add_special_tokens: space(ids=list(x)))

        def __init__(self, model, **given):
            heard.update(model=model, **given)

        def transcribe(self, samples, **given):
            heard.update(n=len(samples), **given)
            return iter([space(start=0.0, end=1.0, text=" hi ", avg_logprob=-0.2, words=[word]), space(start=1.0, end=2.0, text="x", avg_logprob=-1.0, words=None)]), space(language="en")

    monkeypatch.setitem(sys.modules, "faster_whisper", space(WhisperModel=Model))
    got = backends.whisper("tiny", "uk", "cuda")().transcribe(str(path), ["Ann", "x" * 300])
    assert heard["n"] == 16_000 and (heard["model"], heard["language"], heard["hotwords"], heard["compute_type"]) == ("tiny", "uk", "Ann", "float16")
    assert [(s["text"], len(s["words"]), s["avg_logprob"]) for s in got] == [("hi", 1, -0.2), ("x", 0, -1.0)] and got[0]["words"][0] == {"w": " hi", "start": 0.0, "end": 0.4, "p": 0.9}
    turn = space(start=0.0, end=1.0)
    for found in (space(itertracks=lambda yield_label: [(turn, "_", "S1")]), space(speaker_diarization=[(turn, "S1")])):
        monkeypatch.setitem(sys.modules, "torch", space(from_numpy=lambda x: x[None] if x.ndim > 1 else space(unsqueeze=lambda n: x[None])))
        monkeypatch.setitem(sys.modules, "pyannote.audio", space(Pipeline=space(from_pretrained=lambda m, token, found=found: lambda sound, **given: found)))
        assert backends.pyannote(2)().diarize(str(path)) == [{"start": 0.0, "end": 1.0, "speaker": "S1"}]
    monkeypatch.setitem(sys.modules, "faster_whisper", None)
    with pytest.raises(TranscribeError):
        backends.whisper()()
    for bad in ("nothing", "no_such:thing", "json:nothing"):
        with pytest.raises(TalkgridError):
            backends.named(bad)


BACKENDS = '''
from talkgrid.sources import audio

class Words:
    def transcribe(self, path, hotwords):
        n = len(audio.load(path)) / audio.RATE
        return [{"start": float(i), "end": i + 0.5, "text": f"word {i} {' '.join(hotwords or [])}".strip()} for i in range(int(n))]

class Turns:
    def diarize(self, path):
        return [{"start": 0.0, "end": 1.6, "speaker": "A"}, {"start": 1.6, "end": 99.0, "speaker": "B"}]

def frames():
    return lambda path, at: f"{path}@{at:.3f}"

def tiles():
    return lambda path: (1920, 1080, [{"kind": "camera", "x": 0.0, "y": 0.0, "w": 1.0, "h": 1.0, "confidence": 1.0}])

def engine():
    return lambda path, band: ("Ann Sm..." if float(path.split("@")[1]) < 2 else "Guest", 0.9)
'''


@pytest.fixture
def own(tmp_path, monkeypatch, spark):
    (tmp_path / "own_backends.py").write_text(BACKENDS)
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "own_backends.py"))
    return tmp_path


def test_transcribe_command(own, capsys):
    a, b = tone(own / "a.wav", 2, 16_000), tone(own / "b.wav", 2, 16_000)
    given = ["--recognizer", "own_backends:Words", "--diarizer", "own_backends:Turns"]
    assert main(["transcribe", str(a), *given]) == 0
    assert (own / "a.talkgrid.txt").read_text() == "[00:00:00] Speaker 1:\nword 0 word 1" and '"speaker": "A"' in (own / "a.talkgrid.json").read_text()
    (own / "both.txt").write_text("# two\na.wav\nb.wav\n")
    (own / "g.yaml").write_text("terms:\n  - canonical: Kubernetes\n")
    assert main(["transcribe", "-f", str(own / "both.txt"), "--glossary", str(own / "g.yaml"), "--duration", "3", "--work", str(own), *given]) == 0
    text = (own / "both.talkgrid.txt").read_text()
    assert text.startswith("--- a.wav ---\n\n[00:00:00] Speaker 1:\nword 0 Kubernetes word 1") and "--- b.wav ---\n\n[00:00:00] Speaker 2:\nword 2 Kubernetes" in text and "word 3" not in text
    assert str(own / "g.yaml") in (own / "both.talkgrid.json").read_text()
    capsys.readouterr()
    for bad in ([], [str(a), "-f", str(own / "both.txt")], [str(own / "none.wav")], [str(a), "-m", "huge"], [str(a), "--device", "abacus"]):
        assert main(["transcribe", *bad, *given]) == 1 and capsys.readouterr().err


def test_nametag_command(own, capsys):
    (own / "m").mkdir()
    (own / "m" / "talk.mp4").touch(), (own / "m" / "b.named.vtt").write_text("WEBVTT\n")
    given = ["--frames", "own_backends:frames", "--tiles", "own_backends:tiles", "--engine", "own_backends:engine", "--work", str(own)]
    assert main(["nametag", str(own / "m"), "-g", "Ann Smith", *given]) == 1  # its only captions are a result
    (own / "m" / "talk-asr.vtt").write_text("WEBVTT\n\n00:00:00.000 --> 00:00:02.000\nhi\n\n00:00:02.000 --> 00:00:04.000\nyou\n")
    assert main(["nametag", str(own / "m"), "-g", "Ann Smith", *given]) == 0
    assert "1 cues to look at" in capsys.readouterr().out
    assert (own / "m" / "talk.named.vtt").read_text() == "WEBVTT\n\n00:00:00.000 --> 00:00:02.000\nAnn Smith: hi\n\n00:00:02.000 --> 00:00:04.000\nGuest: you\n"
    assert (own / "m" / "talk.named.txt").read_text() == "[00:00:00] Ann Smith:\nhi\n\n[00:00:02] Guest:\nyou\n"
    video = str(own / "m" / "talk.mp4")
    for bad in ([], ["--video", video], [str(own / "m")], [str(own / "none"), "-g", "x"]):
        assert main(["nametag", *bad, *given]) == 1
