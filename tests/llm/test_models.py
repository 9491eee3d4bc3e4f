"""Trained operators: held-out accuracy on the driver's tables, gradients, and edge rows."""

import numpy as np
import pytest
from helpers import DOCS
from pyspark.sql import functions as F

from talkgrid.llm import bigru, language_id, quality_classifier, queries, toxicity
from talkgrid.llm.common import fold

SF = "/root/testdata/sf0.01"
EDGES = [(1, None, None, None, 0), (2, "", "en", "s", 0), (3, "12 %% …", "en", "s", 0), (None, "the end of the world", "en", None, 0), (5, "word " * 40_000, "en", "s", 0), (2, "", "en", "s", 0)]


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")}


def test_backpropagation_through_time_matches_differences():
    rng = np.random.default_rng(0)
    x, u = rng.normal(0, 1, (6, 12, 3)).astype(np.float32), rng.normal(0, 0.5, (12, 4)).astype(np.float32)
    grad = rng.normal(0, 1, (6, 4, 3)).astype(np.float32)
    for reverse in (False, True):
        dx, du = bigru.scan_back(x, u, bigru.scan(x, u, reverse), grad, reverse)
        for array, own in ((x, dx), (u, du)):
            for _ in range(12):
                at = tuple(rng.integers(0, n) for n in array.shape)
                old, h = array[at], np.float32(1e-2)
                array[at] = old + h
                up = float((bigru.scan(x, u, reverse) * grad).sum())
                array[at] = old - h
                down = float((bigru.scan(x, u, reverse) * grad).sum())
                array[at] = old
                assert abs((up - down) / (2 * h) - own[at]) < 0.03 * max(1, abs(own[at]))


def test_languages_of_held_out_documents(spark, tables):
    got = queries.op9_language_id(spark, SF).toPandas().merge(tables["documents"].select("doc_id", "lang", "n_chars").toPandas(), on="doc_id")
    assert list(got.held_out) == list(fold(got.doc_id.to_numpy()))
    out = got[got.held_out & (got.n_chars > 40)]
    assert (out.lang_pred == out.lang).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_pooled_labels_match_a_plain_scan_of_the_stretch():
    p = language_id.train(["the end of the " * 30, "le fin de la vie " * 30], [0, 1], 2, steps=30)
    raw = np.frombuffer(("The fin of la vie, 12 " * 8).encode(), np.uint8)
    q, letters = language_id.Labeller(p)(np.concatenate([raw, raw]), np.array([0, len(raw), 2 * len(raw)]))
    ends = np.zeros(language_id.MARGIN, np.uint8), np.zeros(language_id.STRETCH + language_id.MARGIN - len(raw), np.uint8)
    ids = language_id._FOLD[np.concatenate([ends[0], raw, ends[1]])][:, None]
    x = {d: np.ascontiguousarray(p[f"x{d}"][ids].transpose(0, 2, 1)) for d in "fb"}
    s = {d: bigru.scan(x[d], p[f"u{d}"], d == "b") for d in "fb"}
    each = bigru.softmax(p["vf"] @ s["f"] + p["vb"] @ s["b"] + p["c"][:, None], axis=1)[:, :, 0]
    live = language_id._LETTER[ids[:, 0]]
    assert letters[0] == live.sum() and np.allclose(q, each[live].mean(axis=0), atol=1e-4)


def test_toxic_words_are_found_in_held_out_documents(spark, tables):
    got = queries.op2_toxicity(spark, SF).toPandas().merge(tables["labels"].toPandas(), on="doc_id").merge(tables["documents"].select("doc_id", "lang").toPandas(), on="doc_id")
    out = got[got.held_out & (got.lang == "en") & (got.quality == 1)]
    assert out[out.toxic == 1].predicted.mean() > 0.8 and out[out.toxic == 0].predicted.mean() < 0.05
    assert got.score.between(0, 1).all() and set(got.predicted[got.score >= 0.7]) == {1}


def test_every_word_lies_in_a_window():
    for n in range(0, 200):
        s = toxicity.window_starts(n)
        assert set(range(n)) <= {i + k for i in s for k in range(toxicity.SPAN)} and (n == 0 or s[-1] < n)


def test_quality_of_held_out_documents(spark, tables):
    got = queries.op5_quality_classifier(spark, SF).toPandas().merge(tables["labels"].toPandas(), on="doc_id")
    out = got[fold(got.doc_id.to_numpy())]
    assert out[out.quality == 1].kept.mean() > 0.97 and out[out.quality == 0].kept.mean() < 0.3


def test_views_teach_each_other():
    rng = np.random.default_rng(2)
    y = (rng.random(600) < 0.7).astype(float)
    views = [(rng.normal(0, 1, (600, 5)) + y[:, None]).astype(np.float32), (rng.normal(0, 1, (600, 4)) + 0.7 * y[:, None]).astype(np.float32)]
    choose = quality_classifier.choose_from(np.arange(200), [v[200:400] for v in views])
    model = quality_classifier.co_train([v[:200] for v in views], y[:200], choose, 0.7)
    both, a, b = quality_classifier.combined(model, [v[400:] for v in views])
    right = lambda q: ((q >= 0.5) == y[400:]).mean()
    assert min(model["pseudo"]) > 0 and right(both) >= max(right(a), right(b)) - 0.02 and right(both) > 0.85


def test_choice_over_all_rows_matches_a_choice_in_memory(spark, tables):
    docs = tables["documents"].select("text", "lang", "source").where("length(text) > 0").limit(400)
    rows = docs.unionByName(docs.limit(150)).withColumn("key", F.xxhash64("text", "lang", "source"))
    table, pool = quality_classifier._matrices(rows.distinct().withColumn("quality", F.lit(0)))
    keys = table.column("key").to_numpy()
    rng = np.random.default_rng(4)
    y = (pool[1][:, 128] > np.median(pool[1][:, 128])).astype(float)
    models = [quality_classifier.Logistic(p + rng.normal(0, 1e-3, p.shape).astype(np.float32), y, np.ones(len(y)), 0.02) for p in pool]
    for scale, good, bad in ((3.0, 40, 25), (50.0, 30, 30), (0.01, 20, 20), (50.0, 1000, 1000)):  # 50: most are tied, 0.01: none is sure
        platts = [np.array([scale, 0.0])] * 2
        got = quality_classifier.choose_in(rows)(models, platts, good, bad)
        want = quality_classifier.choose_from(keys, pool)(models, platts, good, bad)
        for (k, t, m), (k0, t0, m0) in zip(got, want, strict=True):
            assert list(k) == list(k0) and list(t) == list(t0) and all(np.array_equal(a, b) for a, b in zip(m, m0, strict=True))
    none = quality_classifier.choose_in(rows.limit(0))(models, platts, 5, 5)
    assert [len(k) for k, _, _ in none] == [0, 0]


def test_labels_only_on_long_texts_and_on_rows_without_text_are_learned_from(spark):
    plain, vile = "the river runs past the old mill and over the stones ", "you rotten filthy scum get lost "
    ids = [i for i in range(200) if not fold(np.array([i]))[0]][:80]
    docs = [(i, (plain * 3 + vile) * 450 if k % 2 else plain * 12 + f"word{k}", "en", "s", 0) for k, i in enumerate(ids)]
    docs += [(i, None, "en", "s", 0) for i in range(1000, 1400)]
    labels = spark.createDataFrame([(i, 1, k % 2) for k, i in enumerate(ids)] + [(i, 1, 1) for i in range(1000, 1400)], "doc_id long, quality int, toxic int")
    assert min(len(d[1]) for d in docs[1:80:2]) > toxicity.LONGEST
    got = {r.doc_id: r.score for r in toxicity.toxicity(spark.createDataFrame(docs, DOCS), labels).collect()}
    assert min(got[i] for i in ids[1::2]) > 0.7 > 0.3 > max(got[i] for i in ids[::2])


def test_edge_rows_empty_tables_and_clashing_columns(spark, tables):
    known = tables["documents"].select("doc_id", "text", "lang", "source", "n_chars").withColumn("doc_id", F.col("doc_id") + 1000)
    labels = tables["labels"].withColumn("doc_id", F.col("doc_id") + 1000)
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 1), (1, None, None), (1001, 1, None)], labels.schema))
    docs = known.unionByName(spark.createDataFrame(EDGES, DOCS)).withColumns({"score": F.lit("s"), "held_out": F.lit(1), "quality": F.lit("q"), "toxic": F.lit(3), "_n": F.lit(0)})
    n = docs.count()
    for run in (lambda d, y: toxicity.toxicity(d, y), lambda d, y: quality_classifier.quality_scores(d, y), lambda d, y: language_id.identify(d)):
        got = run(docs, labels)
        rows = got.where("doc_id IS NULL OR doc_id < 1000").collect()
        assert got.count() == n and len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
        assert run(docs.limit(0), labels).count() == 0
        assert run(spark.createDataFrame(EDGES, DOCS), labels.limit(0)).count() == len(EDGES)
    langs = {r.doc_id: r.lang_pred for r in language_id.identify(docs).where("doc_id < 1000").collect()}
    assert langs[1] == langs[2] == langs[3] == "und" and langs[5] != "und"
