"""Interval joins against plain loops over random intervals with ties, touching ends, zero lengths and repeats."""

import random

import pytest

from talkgrid.operators import intervals as iv

SEG = "recording_id int, seg_idx int, start double, end double, text string"
TURN = "recording_id int, turn_idx int, start double, end double, speaker string"


def data(seed, n=60, m=40):
    rng = random.Random(seed)
    at = lambda: rng.randrange(0, 400) / 2
    long = lambda: rng.choice([0, 0.5, 1, 2, 5, 90])
    segs = [(rng.randrange(4), i, s := at(), s + long(), f"t{i}") for i in range(n)]
    turns = [(rng.randrange(3), i, s := at(), s + long(), f"S{i % 5}") for i in range(m)]
    return segs, turns


def loop_attribute(seg, turns):
    best, label = 0, None
    for _, _, s, e, who in turns:
        over = min(e, seg[3]) - max(s, seg[2])
        if over > best:
            best, label = over, who
    if label is None and turns:
        mid = (seg[2] + seg[3]) / 2
        label = min(turns, key=lambda t: min(abs(t[2] - mid), abs(t[3] - mid)))[4]
    return label or "UNKNOWN"


@pytest.mark.parametrize("seed", range(3))
def test_attribution(spark, seed):
    segs, turns = data(seed)
    got = iv.attribute(spark.createDataFrame(segs, SEG), spark.createDataFrame(turns, TURN), width=7)
    want = {s[1]: loop_attribute(s, [t for t in turns if t[0] == s[0]]) for s in segs}
    assert {r.seg_idx: r.speaker for r in got.collect()} == want


def test_attribution_of_touching_empty_and_lonely_segments(spark):
    segs = [(1, 0, 1.0, 3.0, ""), (1, 1, 50.0, 50.0, ""), (2, 0, 0.0, 1.0, "")]
    turns = [(1, 0, 0.0, 2.0, "A"), (1, 1, 2.0, 4.0, "B"), (1, 2, 0.0, 100.0, "C"), (1, 3, 50.5, 60.0, "D")]
    got = {(r.recording_id, r.seg_idx): r.speaker for r in iv.attribute(spark.createDataFrame(segs, SEG), spark.createDataFrame(turns, TURN)).collect()}
    assert got == {(1, 0): "C", (1, 1): "D", (2, 0): "UNKNOWN"}


@pytest.mark.parametrize("seed", range(2))
def test_gather_hits_and_pairs(spark, seed):
    segs, turns = data(seed + 10)
    s = spark.createDataFrame(segs, SEG)
    c = spark.createDataFrame(turns, TURN).selectExpr("recording_id", "turn_idx AS cue_idx", "start", "end", "concat(' ', speaker, '\n') AS text")
    meets = lambda a, b: a[0] == b[0] and a[2] < b[3] and b[2] < a[3]
    want = {x[1]: " ".join(dict.fromkeys(t[4] for t in turns if meets(x, t))) for x in segs}
    assert {r.seg_idx: r.caption_text for r in iv.gather_text(s, c, "seg_idx", width=9).collect()} == want
    hit = {r.recording_id: (r.n_cues, r.n_hit) for r in iv.hit_fraction(c, s, 9).collect()}
    assert hit == {k: (len(own), sum(any(meets(x, t) for x in segs) for t in own)) for k in {t[0] for t in turns} if (own := [t for t in turns if t[0] == k])}
    pairs = sorted((r.l_seg_idx, r.r_cue_idx) for r in iv.overlap_pairs(s, c, 9).collect())
    assert pairs == sorted((x[1], t[1]) for x in segs for t in turns if meets(x, t))


def test_names_and_files(spark):
    spans = spark.createDataFrame([(1, 0, 0.0, 5.0), (1, 1, 9.0, 10.0)], "recording_id int, span_idx int, start double, end double")
    cues = spark.createDataFrame([(1, 0, 0.0, 2.0, "Ann"), (1, 1, 2.0, 5.0, "Bob"), (1, 2, 10.0, 12.0, "Cy")], "recording_id int, cue_idx int, start double, end double, name string")
    assert [r.name for r in iv.span_names(spans, cues).orderBy("span_idx").collect()] == ["Bob", ""]
    files = spark.createDataFrame([(1, 0, "a.mp4", 0.0), (1, 1, "b.mp4", 10.0)], "recording_id int, file_idx int, filename string, offset double")
    segs = spark.createDataFrame([(1, 0, 9.5, 11.0, ""), (1, 1, 10.0, 12.0, "")], SEG)
    assert [(r.filename, r.start, r.end) for r in iv.file_of(segs, files).orderBy("seg_idx").collect()] == [("a.mp4", 9.5, 11.0), ("b.mp4", 0.0, 2.0)]
