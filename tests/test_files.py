"""Readers, writers and whole plans over files."""

import json

import pytest
import yaml
from pyspark.sql import functions as F

import sys

from pyspark import cloudpickle

from talkgrid.errors import CrosscheckError, DictionaryError, TalkgridError
from talkgrid.functions import fuzzy, geometry
from talkgrid.plans import crosscheck as cross
from talkgrid.plans import nametag, review, transcribe
from talkgrid.plans.glossary import merge_file
from talkgrid.sources import media, readers, writers
from talkgrid.streaming.sessions import span_sessions

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VTT = "WEBVTT\r\nKind: captions\r\n\r\nNOTE something\r\n\r\nNOTE --> not a cue\r\n\r\n1\r\n00:00:00.000 --> 00:00:02.000\r\nAnn: hello there\r\nsecond line\r\n\r\n00:02.500 --> 00:05.000\r\nBob: good morning\r\n\r\n00:00:06.000 --> 00:00:07.000\r\n"
TRANSCRIPT = {
    "language": "en", "model": "m", "hotwords_from": [],
    "segments": [
        {"start": 0, "end": 2, "speaker": "SPEAKER_00", "text": "hello there second line", "avg_logprob": -0.1, "words": [{"w": " hello", "start": 0, "end": 1, "p": 0.9}]},
        {"start": 2.5, "end": 4, "text": "quite other words", "extra": 1},
        {"start": 4.5, "end": 5, "speaker": "SPEAKER_01", "text": "cube are netes", "avg_logprob": -0.9},
    ],
}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "m1.json").write_text(json.dumps(TRANSCRIPT))
    (tmp_path / "m1.vtt").write_bytes(VTT.encode())
    (tmp_path / "g.yaml").write_text("# names\nterms:\n  - canonical: Kubernetes\n    category: product\n    misheard:\n      - Cube are netes  # often\n  - canonical: Ann\n    category: person\n    misheard: [an]\n  - canonical: Zed\n    category: term\n")
    return tmp_path


def test_transcripts_and_captions(spark, folder):
    s = readers.read_transcripts(spark, f"{folder}/m1.json").orderBy("seg_idx").collect()
    assert [(r.recording_id, r.start, r.speaker, r.avg_logprob, len(r.words)) for r in s] == [("m1", 0.0, "SPEAKER_00", -0.1, 1), ("m1", 2.5, "UNKNOWN", 0.0, 0), ("m1", 4.5, "SPEAKER_01", -0.9, 0)]
    assert s[0].words[0].w == " hello"
    cues = readers.named_cues(readers.read_vtt(spark, f"{folder}/m1.vtt")).orderBy("cue_idx").collect()
    assert [(r.cue_idx, r.start, r.end, r.text, r.name) for r in cues] == [(0, 0.0, 2.0, "Ann: hello there\nsecond line", "Ann"), (1, 2.5, 5.0, "Bob: good morning", "Bob"), (2, 6.0, 7.0, "", "")]
    assert readers.vtt_headers(readers.read_files(spark, f"{folder}/m1.vtt")).first().header == "WEBVTT\nKind: captions"
    for bad in ("{", "{}", '{"segments":[{"start":1}]}'):
        (folder / "bad.json").write_text(bad)
        with pytest.raises(Exception, match="not a transcript"):
            readers.read_transcripts(spark, f"{folder}/bad.json").collect()


def test_yaml_and_lists(spark, folder):
    g = readers.load_glossary(folder / "g.yaml")
    assert [e.canonical for e in g] == ["Kubernetes", "Ann", "Zed"] and readers.glossary_table(spark, g).count() == 3
    for text in ("a: 1", "terms: [{category: term}]", "terms: [{canonical: A, category: x}]", "terms: ["):
        (folder / "bad.yaml").write_text(text)
        with pytest.raises(DictionaryError):
            readers.load_glossary(folder / "bad.yaml")
    with pytest.raises(DictionaryError):
        readers.load_glossary(folder / "none.yaml")
    with pytest.raises(DictionaryError):
        readers.load_glossaries([folder / "g.yaml", folder / "g.yaml"])
    (folder / "r.yaml").write_text("permanent: [Ann, Bob]")
    assert readers.load_roster(folder / "r.yaml") == ["Ann", "Bob"]
    (folder / "l.txt").write_text("# list\n\na.mp4\n/b.mp4\n")
    assert [str(p) for p in readers.resolve_file_list(folder / "l.txt")] == [f"{folder}/a.mp4", "/b.mp4"]
    with pytest.raises(TalkgridError):
        readers.check_inputs([folder])
    for name in ("b.mp4", "a.mp4", "a.named.vtt"):
        (folder / name).write_text("-")
    r = readers.discover(spark, str(folder)).first()
    assert r.video.endswith("/a.mp4") and r.captions.endswith("/m1.vtt")
    with pytest.raises(TalkgridError):
        readers.parse_choice("CPU", ["cpu"])


def test_glossary_defaults_and_lists(tmp_path):
    (tmp_path / "g.yaml").write_text("terms:\n- canonical: Ann\n")
    assert [(e.category, e.misheard) for e in readers.load_glossary(tmp_path / "g.yaml")] == [("term", [])]
    (tmp_path / "bad.yaml").write_text("terms:\n- canonical: Ann\n  misheard: an\n")
    with pytest.raises(TalkgridError):
        readers.load_glossary(tmp_path / "bad.yaml")


def test_glossary_merge_keeps_comments(folder):
    (folder / "c.yaml").write_text('corrections:\n  - canonical: "Kubernetes"\n    heard: "cooper netes"\n  - canonical: Ann\n    heard: anne\n  - canonical: Zed\n    heard: zet\n  - {canonical: New, heard: knew, category: term}\n')
    done = merge_file(folder / "g.yaml", folder / "c.yaml")
    text = (folder / "g.yaml").read_text()
    assert "# names" in text and "# often" in text and done.added_entries == ["New"]
    assert [(e.canonical, e.misheard) for e in readers.load_glossary(folder / "g.yaml")] == [("Kubernetes", ["Cube are netes", "cooper netes"]), ("Ann", ["an", "anne"]), ("Zed", ["zet"]), ("New", ["knew"])]
    assert merge_file(folder / "g.yaml", folder / "c.yaml").unchanged == 4 and (folder / "g.yaml").read_text() == text
    (folder / "c.yaml").write_text("corrections: [{canonical: Zed, heard: AN}]")
    with pytest.raises(DictionaryError):
        merge_file(folder / "g.yaml", folder / "c.yaml")
    assert (folder / "g.yaml").read_text() == text
    flow = folder / "flow.yaml"
    flow.write_text("terms: [{canonical: A, category: term, misheard: [b]}]\n")
    (folder / "c.yaml").write_text("corrections: [{canonical: A, heard: c}]")
    merge_file(flow, folder / "c.yaml")
    assert yaml.safe_load(flow.read_text())["terms"][0]["misheard"] == ["b", "c"]


def test_crosscheck_to_review(spark, folder):
    segments, cues = readers.read_transcripts(spark, f"{folder}/m1.json"), readers.read_vtt(spark, f"{folder}/m1.vtt")
    glossary = readers.glossary_table(spark, readers.load_glossary(folder / "g.yaml"))
    spans = cross.crosscheck(segments, cues, glossary.where("canonical != 'Ann'"))
    got = spans.collect()
    assert [(r.span_idx, r.start, r.end, r.reasons, r.suggestion) for r in got] == [(0, 2.5, 5.0, ["divergence", "low_confidence", "misheard_match"], "Kubernetes")]
    assert got[0].caption_text == "Bob: good morning Bob: good morning" and got[0].asr_text == "quite other words cube are netes"
    assert cross.crosscheck(segments, None, None).collect()[0].reasons == ["low_confidence"]
    far = cues.withColumn("start", F.col("start") + 900).withColumn("end", F.col("end") + 900)
    with pytest.raises(Exception, match="Only 0% of the captions"):
        cross.crosscheck(segments, far, None).collect()
    with pytest.raises(CrosscheckError):
        readers.require_pairing(0.1)
    doc = writers.flags_json(spans).first().document
    (folder / "f.json").write_text(writers.indented(doc))
    assert '"suggestion"' in doc
    back = readers.read_flags(spark, f"{folder}/f.json").drop("recording_id").collect()
    assert back == spans.select("span_idx", "start", "end", "caption_text", "asr_text", "reasons", "suggestion").collect()
    rows = review.review_rows(spans, readers.named_cues(cues), spark.createDataFrame([("m1", "v.mp4")], "recording_id string, path string"), 5, str(folder), lambda: lambda command: command[2:4] == ["-ss", "0.000"])
    r = rows.first()
    assert (r.name, r.timestamp, r.made) == ("Bob", "[00:00:02]", True) and "<mark>" in r.asr_html
    html = review.page(rows, "m1", "Review <m1>")
    assert "Review &lt;m1&gt;" in html and 'value="Kubernetes"' in html and html.count("<section") == 1
    assert review.summary(rows).first().n_clips == 1
    (folder / "x.json").write_text("{}")
    with pytest.raises(Exception, match="not a flags file"):
        readers.read_flags(spark, f"{folder}/x.json").collect()


class Words:
    def transcribe(self, path, hotwords):
        return [{"start": 0.0, "end": 2.0, "text": f"from {path}"}, {"start": 2.0, "end": 5.0, "text": " ".join(hotwords or [])}]


class Turns:
    def diarize(self, path):
        return [{"start": 0.0, "end": 2.0, "speaker": "SPEAKER_01"}, {"start": 2.0, "end": 9.0, "speaker": "SPEAKER_00"}]


def test_transcribe_plan_and_writers(spark, folder):
    recordings = spark.createDataFrame([("r1", "a.wav"), ("r2", "b.wav")], "recording_id string, path string")
    glossary = readers.glossary_table(spark, readers.load_glossary(folder / "g.yaml"))
    s = transcribe.attributed(recordings, Words, Turns, glossary)
    text = {r.recording_id: r.document for r in transcribe.text_of(s).collect()}
    assert text["r1"] == "[00:00:00] Speaker 2:\nfrom a.wav\n\n[00:00:02] Speaker 1:\nAnn Kubernetes Zed"
    files = spark.createDataFrame([("r1", 0, "a.mp3", 2.0), ("r1", 1, "b.mp3", 9.0), ("r2", 0, "c.mp3", 99.0)], "recording_id string, file_idx int, filename string, duration double")
    text = {r.recording_id: r.document for r in transcribe.text_of(s, files).collect()}
    assert text["r1"] == "--- a.mp3 ---\n\n[00:00:00] Speaker 2:\nfrom a.wav\n\n--- b.mp3 ---\n\n[00:00:00] Speaker 1:\nAnn Kubernetes Zed" and not text["r2"].startswith("---")
    heads = spark.createDataFrame([("r1", "en", "m", ["g"]), ("r9", None, "m", [])], "recording_id string, language string, model string, hotwords_from array<string>")
    docs = {r.recording_id: json.loads(r.document) for r in writers.transcript_json(s, heads).collect()}
    assert docs["r1"]["segments"][0]["speaker"] == "SPEAKER_01" and docs["r9"] == {"language": None, "model": "m", "hotwords_from": [], "segments": []}
    writers.write_documents(transcribe.text_of(s), str(folder / "out"))
    assert (folder / "out" / "recording_id=r1").is_dir()
    probed = media.probe_durations(files.withColumn("path", F.col("filename")), lambda: lambda p: float(len(p)))
    assert {r.duration for r in probed.collect()} == {5.0}


def test_nametag_plan(spark):
    cues = spark.createDataFrame([("m", 0, 0.0, 2.0, "hi\nyou"), ("m", 1, 2.0, 4.0, ""), ("m", 2, 9.0, 9.0, "x")], "recording_id string, cue_idx int, start double, end double, text string")
    videos = spark.createDataFrame([("m", "v.mp4")], "recording_id string, path string")
    tile = {"kind": "camera", "x": 0.0, "y": 0.0, "w": 1.0, "h": 1.0, "confidence": 1.0}
    frames = lambda: lambda path, at: None if at > 8 else f"{path}@{at:.3f}"
    engine = lambda: lambda path, band: ("Ann Sm..." if float(path.split("@")[1]) < 2 else "Guest", 0.9)
    out = nametag.name_cues(cues, videos, ["Ann Smith", "Bob Jones"], frames, lambda: lambda path: (1920, 1080, [tile]), [engine])
    got = {r.cue_idx: (r.name, r.frames_used) for r in out.collect()}
    assert got == {0: ("Ann Smith", 7), 1: ("Guest", 7), 2: ("Unknown", 0)}
    doc = writers.named_vtt(out, spark.createDataFrame([("m", "WEBVTT")], "recording_id string, header string")).first().document
    assert doc.startswith("WEBVTT\n\n00:00:00.000 --> 00:00:02.000\nAnn Smith: hi\nyou\n\n00:00:02.000 --> 00:00:04.000\nGuest:\n") and doc.endswith("Unknown: x\n")
    assert writers.annotation_text(out).first().document == "[00:00:00] Ann Smith:\nhi you\n\n[00:00:02] Guest:\n\n\n[00:00:09] Unknown:\nx\n"


def test_names_and_diffs():
    names = ["Mykola Havrylov", "Ann Smith", "Анна Коваль"]
    assert fuzzy.match("Mykola Ha…", names) == ("Mykola Havrylov", 1.0, True)
    assert fuzzy.match("Ann Smith LOGO", names).matched and fuzzy.match("Анна Ковапь", names).name == "Анна Коваль"
    assert fuzzy.match("An", names) == ("An", 0.0, False) and not fuzzy.match("Guest...", names).matched
    assert fuzzy.clean_name(" A  b...") == "A b"
    assert fuzzy.marked("the Cat <b>", "The dog <b>") == ("the <mark>Cat</mark> &lt;b&gt;", "The <mark>dog</mark> &lt;b&gt;")
    reads = []
    media.read_until_decided(list("abcdefg"), lambda p: reads.append(p) or media.Match("Ann", 1.0, True))
    assert len(reads) == 4


def test_geometry():
    import numpy as np

    f = np.zeros((40, 100, 3))
    f[5:20, 30:60] = 200
    assert geometry.lit_area(f) == (30, 5, 30, 15) and geometry.has_side_bars(f) and geometry.lit_area(np.zeros((4, 6))) == (0, 0, 6, 4)
    assert not geometry.has_side_bars(f[:, 30:]) and not geometry.has_side_bars(np.zeros((4, 6)))
    x = np.random.default_rng(1).random(40)
    for n in (1, 4, 7):
        assert np.allclose(geometry.box_smooth(x, n), np.convolve(x, np.full(max(3, n), 1 / max(3, n)), mode="same"))
    crop = np.zeros((5, 6, 3))
    crop[2, [1, 3]], crop[0, 5] = 255, (255, 0, 0)  # a gap of one pixel; blue is not bright
    white = geometry.white_text(crop)
    assert white.shape == crop.shape and [tuple(map(int, p)) for p in np.argwhere(white[..., 0])] == [(2, 1), (2, 2), (2, 3)]
    assert not geometry.is_audible(np.zeros(9)) and geometry.is_audible(np.full(9, 0.1)) and not geometry.is_audible(np.zeros(0))


def test_sessions_on_a_stream(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", 5.0), ("a", "2024-01-01 00:00:07", 1.0), ("a", "2024-01-01 00:00:30", 1.0), ("a", "2024-01-01 02:00:00", 1.0)]
    spark.createDataFrame(rows, "k string, ts string, seconds double").selectExpr("k", "cast(ts as timestamp) ts", "seconds").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, ts timestamp, seconds double").parquet(f"{tmp_path}/in")
    q = span_sessions(stream, "k", "ts", "seconds", 2.0, "1 minute").writeStream.format("memory").queryName("spans_seen").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT cast(start AS string) s, cast(end AS string) e, n FROM spans_seen ORDER BY 1").collect()
    assert [tuple(r) for r in got][:2] == [("2024-01-01 00:00:00", "2024-01-01 00:00:08", 2), ("2024-01-01 00:00:30", "2024-01-01 00:00:31", 1)]
