import random

import pytest

from talkgrid.operators import flags, glossary, ranking, spans, votes
from talkgrid.errors import DictionaryError

FLAGGED = "recording_id int, seg_idx int, start double, end double, caption_text string, asr_text string, reasons array<string>, suggestion string"


def loop_merge(rows, gap):
    out = []
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        if out and r[2] - out[-1][1] <= gap:
            o = out[-1]
            o[1] = max(o[1], r[3])
            o[2] += [r[4]] if r[4] else []
            o[3] += [r[5]] if r[5] else []
            o[4] += [x for x in r[6] if x not in o[4]]
            o[5] = o[5] if o[5] is not None else r[7]
        else:
            out.append([r[2], r[3], [r[4]] if r[4] else [], [r[5]] if r[5] else [], list(dict.fromkeys(r[6])), r[7]])
    return [(o[0], o[1], " ".join(o[2]), " ".join(o[3]), o[4], o[5]) for o in out]


def test_merge_matches_a_loop(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), i, s := float(rng.randrange(0, 300)), s + rng.choice([0.0, 1.0, 4.0]), rng.choice(["", f"c{i}"]), rng.choice(["", f"a{i}"]), rng.sample(list(flags.PRIORITY), rng.randrange(1, 4)), rng.choice([None, f"s{i}"])) for i in range(200)]
    got = spans.merge_spans(spark.createDataFrame(rows, FLAGGED)).orderBy("recording_id", "span_idx").collect()
    want = [(k, n, *x) for k in range(3) for n, x in enumerate(loop_merge([r for r in rows if r[0] == k], 2.0))]
    assert [tuple(r) for r in got] == want


WORDS = "array<struct<w:string,start:double,end:double,p:double>>"


@pytest.mark.parametrize(
    ("text", "caption", "probs", "logprob", "captions", "want"),
    [
        ("one two", "three four", [], 0.0, True, (["divergence"], None)), ("same words", "same words", [], 0.0, True, ([], None)), ("x", "x", [0.3, 0.39], 0.0, True, (["low_confidence"], None)),
        ("x", "x", [0.3, 0.4], 0.0, True, ([], None)), ("x", "x", [], -0.9, True, (["low_confidence"], None)), ("x", "x", [], -0.8, True, ([], None)), ("the cube are netes", "the cube are netes", [], 0.0, True, (["misheard_match"], "Kubernetes")),
        ("a", "Cube are netes", [], -1.0, True, (["divergence", "low_confidence", "misheard_match"], "Kubernetes")), ("one", "", [], 0.0, False, ([], None)), ("", "", [], 0.0, True, ([], None)),
    ],
)
def test_flags(spark, text, caption, probs, logprob, captions, want):
    g = spark.createDataFrame([(0, "Kubernetes", "term", None, ["Cube are netes!"]), (1, "Other", "term", None, ["netes"])], "entry_idx int, canonical string, category string, note string, misheard array<string>")
    s = spark.createDataFrame([(1, 0, 0.0, 1.0, text, caption, logprob, [("w", 0.0, 1.0, p) for p in probs])], f"recording_id int, seg_idx int, start double, end double, text string, caption_text string, avg_logprob double, words {WORDS}")
    r = flags.flag_segments(s, flags.misheard_index(g), captions, keep_all=True).first()
    assert (r.reasons, r.suggestion) == want


def test_large_dictionaries_give_the_same_answer(spark):
    g = spark.createDataFrame([(i, f"C{i}", "term", None, [f"heard {i}"]) for i in range(30)], "entry_idx int, canonical string, category string, note string, misheard array<string>")
    d = spark.createDataFrame([(i, f"we Heard {i} and heard {i + 1}") for i in range(40)], "doc_id int, text string")
    index = flags.misheard_index(g)
    one, two = (sorted(map(tuple, flags.find_misheard(d, "text", index, "s", n).select("doc_id", "s").collect()), key=str) for n in (2000, 5))
    assert one == two


def test_ranking(spark):
    rows = [(1, 0, 5.0, ["low_confidence"]), (1, 1, 1.0, ["divergence"]), (1, 2, 9.0, ["low_confidence", "misheard_match"]), (1, 3, 1.0, ["divergence"]), (1, 4, 0.0, []), (2, 0, 0.0, ["odd"])]
    s = spark.createDataFrame(rows, "recording_id int, span_idx int, start double, reasons array<string>")
    got = ranking.rank_spans(s).where("recording_id = 1").orderBy("rank").collect()
    assert [r.span_idx for r in got] == [2, 1, 3, 0, 4]
    assert ranking.rank_spans(s, 2).count() == 3 and ranking.rank_spans(s, 0).count() == 0
    assert [r.span_idx for r in ranking.top_spans(s, 2).collect()] == [2, 1]
    with pytest.raises(ValueError):
        ranking.rank_spans(s, -1)
    named = spark.createDataFrame([("Ann",), ("Unknown",), ("Zed",), (None,)], "name string")
    assert ranking.needs_review(named, ["Ann"]).count() == 3


def test_runs_labels_times_and_budgets(spark):
    segs = spark.createDataFrame([(1, i, float(i), i + 1.0, w, f"t{i}") for i, w in enumerate(["UNKNOWN", "SPEAKER_01", "SPEAKER_01", "UNKNOWN"])], "recording_id int, seg_idx int, start double, end double, speaker string, text string")
    assert [(r.speaker, r.start, r.text) for r in spans.speaker_blocks(segs).orderBy("run").collect()] == [("UNKNOWN", 0.0, "t0"), ("SPEAKER_01", 1.0, "t1 t2"), ("UNKNOWN", 3.0, "t3")]
    assert {r.speaker: r.label for r in spans.speaker_labels(segs).collect()} == {"UNKNOWN": "Speaker 1", "SPEAKER_01": "Speaker 2"}
    cues = spark.createDataFrame([(1, 0, 0.0, 2.0), (1, 1, 0.0, 10.0), (1, 2, 3.0, 3.0)], "recording_id int, cue_idx int, start double, end double")
    assert {r.cue_idx: r["count"] for r in spans.cue_frame_times(cues).groupBy("cue_idx").count().collect()} == {0: 7, 1: 21, 2: 1}
    terms = spark.createDataFrame([(1, 0, 100), (1, 1, 121), (1, 2, 1), (2, 0, 300)], "recording_id int, entry_idx int, n_tokens int")
    assert sorted((r.recording_id, r.entry_idx) for r in spans.within_budget(terms).collect()) == [(1, 0), (1, 1)]
    frames = spark.createDataFrame([(1, i, [x, 0.0]) for i, x in enumerate([0.0, 0.05, 0.2, 0.21])], "recording_id int, frame int, f array<double>")
    assert [tuple(r)[1:] for r in spans.change_points(frames, "f", "frame").orderBy("first").collect()] == [(0, 1, 0), (2, 3, 2)]
    frags = spark.createDataFrame([(1, 0, 0, 0.5, 0.6, "LOGO", 0.9), (1, 0, 1, 0.0, 0.1, "Ann", 0.8), (1, 0, 2, 0.15, 0.3, "Lee ", 0.6), (1, 1, 0, 0.0, 0.1, " ", 0.5)], "recording_id int, frame_idx int, frag_idx int, left double, right double, text string, confidence double")
    assert {r.frame_idx: (r.text, round(r.confidence, 6)) for r in spans.reading_of(frags).collect()} == {0: ("Ann Lee", 0.7), 1: ("", 0.0)}


def test_votes(spark):
    m = lambda n, s, k=True: votes.Reading(n, s, k)
    assert votes.vote([m("Ann", 0.9), m("Ann", 0.9), m("Bob", 1.0)]).name == "Ann"
    assert votes.vote([m("Ann", 0.8), m("Bob", 0.9)]).name == "Bob"
    assert votes.vote([None, None]) == ("Unknown", {}, 0)
    assert votes.vote([m("Guest Perso", 0.5, False), m("Guest Person", 0.5, False), m("Zed", 0.6, False)]).name == "Guest Perso"
    assert votes.vote([m("xx yy", 0.1, False), m("xx yy", 0.1, False), m("Ann", 0.9)]).name == "Ann"
    assert votes.is_decided([m("Ann", 1)] * 4, 7) and not votes.is_decided([m("Ann", 1)] * 3, 7)
    rows = [(1, 0, 2, "Ann", 0.9, True), (1, 0, 1, None, None, None), (1, 0, 0, "Bob", 0.9, True), (1, 0, 3, "Ann", 0.8, True), (1, 1, 0, None, None, None)]
    got = votes.vote_cues(spark.createDataFrame(rows, "recording_id int, cue_idx int, frame_idx int, name string, score double, matched boolean"))
    assert {r.cue_idx: (r.name, r.frames_used) for r in got.collect()} == {0: ("Ann", 3), 1: ("Unknown", 0)}


def test_glossary_checks_and_merge(spark):
    e = glossary.Entry
    for bad in ([e("A", "term"), e("a", "term")], [e("A", "term", None, ["x"]), e("B", "term", None, ["X"])], [e("A", "odd")]):
        with pytest.raises(DictionaryError):
            glossary.check(bad)
    glossary.check([e("A", "term", None, ["x", "x"])])
    c = glossary.Correction
    out, done = glossary.merge([e("A", "term", None, ["x"])], [c("A", "X"), c("A", "y"), c("N", "z", "person"), c("N", "q"), c("N", "Z")])
    assert [(x.canonical, x.category, x.misheard) for x in out] == [("A", "term", ["x", "y"]), ("N", "person", ["z", "q"])]
    assert (done.added_entries, done.added_misheard, done.unchanged) == (["N"], [("A", "y"), ("N", "q")], 2)
    assert glossary.merge(out, [c("A", "y")])[1].unchanged == 1
    with pytest.raises(DictionaryError):
        glossary.merge(out, [c("A", "z")])
    g = spark.createDataFrame([(0, "A", "term", None, ["x"])], "entry_idx int, canonical string, category string, note string, misheard array<string>")
    rows = spark.createDataFrame([(0, "A", "X", "term"), (1, "A", "y", "term"), (2, "N", "z", "person"), (3, "N", "q", "term"), (4, "N", "Z", "term")], "corr_idx int, canonical string, heard string, category string")
    assert [(r.canonical, r.category, r.misheard) for r in glossary.merge_at_scale(g, rows).collect()] == [("A", "term", ["x", "y"]), ("N", "person", ["z", "q"])]
    words = spark.createDataFrame([(i, c) for i, c in enumerate(["term", "product", "person", "company", "person"])], "entry_idx int, category string")
    assert [r.entry_idx for r in ranking.hotwords(words).orderBy("rank").collect()] == [2, 4, 3, 1, 0]
