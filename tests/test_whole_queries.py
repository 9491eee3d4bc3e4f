"""Registered queries over small tables written here, held against plain loops: whole texts, every item, every row."""

from difflib import SequenceMatcher
from html import escape

import pytest

from talkgrid import queries


def write(spark, folder, docs, items):
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def plain_diff(left, right):
    a, b = left.split(), right.split()
    same = [m for m in SequenceMatcher(None, left.lower().split(), right.lower().split()).get_matching_blocks() if m.size]
    kept = [{m[side] + k for m in same for k in range(m.size)} for side in (0, 1)]
    return tuple(" ".join(escape(w) if i in own else f"<mark>{escape(w)}</mark>" for i, w in enumerate(words)) for words, own in ((a, kept[0]), (b, kept[1])))


def test_token_diff_reads_whole_texts(spark, tmp_path):
    items = [(i, f"Item {i} <b> ends with words {i * 3} of its own") for i in range(40)]
    docs = [(i, " ".join(f"w{i * k}" for k in range(90 + 100 * i)) + f" item {i} <B> says words & more of its own w{i}") for i in range(5)]
    got = {r.doc_id: (r.left, r.right) for r in queries.token_diff(spark, write(spark, tmp_path, docs, items)).collect()}
    assert got == {i: plain_diff(items[i][1], text) for i, text in docs}
    assert min(len(text) for _, text in docs) > 300


def plain_suggestion(text, items):
    heard = {}
    for i, t in items:
        heard.setdefault(" ".join(t.split()[:2]), []).append(f"item {i}")
    return next((names[-1] for h, names in heard.items() if h in (text or "")), None)


@pytest.mark.parametrize("n", [75, 2100])  # as one literal, and as two
def test_misheard_dictionary_has_every_item(spark, tmp_path, n):
    items = [(i, f"head{i % (n - 5)} tail rest of item {i}") for i in range(n)]
    docs = [(0, "says head3 tail"), (1, f"head{n - 6} tail and head50 tail"), (2, "nothing"), (None, "head60 tail"), (None, "head41 tail"), (None, None), (3, "head70 tail"), (3, "head44 tail")]
    folder = write(spark, tmp_path, docs, items)
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert key(queries.misheard_lookup(spark, folder).collect()) == key((i, plain_suggestion(t, items)) for i, t in docs)
    index = {r.heard: r.canonical for r in queries.misheard_index(spark, folder).collect()}
    assert index == {h: plain_suggestion(h, [x for x in items if x[1].startswith(f"{h} ")]) for h in {" ".join(t.split()[:2]) for _, t in items}}


def test_every_item_and_every_document_is_paired(spark, tmp_path):
    items = [(3 * i + 7, f"item{i} common words") for i in range(90)]  # 0 to 39 are not all there
    docs = [(i, f"text with item{i % 90} and common") for i in range(180)] + [(None, "item1 <common>"), (-1, "item89")]
    folder = write(spark, tmp_path, docs, items)
    caption = lambda i: None if i is None else items[i % 90][1]
    share = lambda i, t: None if i is None else len(set(caption(i).split()) & set(t.split())) / 3
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert key(queries.token_containment(spark, folder).collect()) == key((i, share(i, t)) for i, t in docs)
    assert key(queries.token_diff(spark, folder).collect()) == key((i, *plain_diff(caption(i) or "", t)) for i, t in docs)
    # normalised, only the text without an id holds an item's first two words: the others' suggestions come from captions
    flagged = {r.seg_idx: r.suggestion for r in queries.segment_flags(spark, folder).collect()}
    assert {i: s for i, s in flagged.items() if i is not None} == {i: f"item {items[i % 90][0]}" for i, _ in docs if i is not None}
    n = {r.reason: r.n for r in queries.reason_histogram(spark, folder).collect()}
    assert flagged[None] == f"item {items[1][0]}"
    assert n["misheard_match"] == 182
    # here it is the text's tokens that are looked for in the caption
    assert n["divergence"] == sum(len(set(t.split()) & set(caption(i).split())) / len(set(t.split())) < 0.5 for i, t in docs if i is not None)
