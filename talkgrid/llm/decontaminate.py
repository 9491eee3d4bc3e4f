"""Benchmark decontamination over a positional inverted index.

1. One pass over the training texts cuts them into segments of about `SEGMENT` bytes and stores, for each
   segment, the postings of every token: sorted term hashes, and for each term its sorted places in the
   segment. The index is dealt by documents, so no term is hot, and nothing is shuffled to build it.
2. Test items are cut into windows of `size` words. Distinct windows are searched in blocks of at most about
   `block`, each a pass over the index, not over the texts: what a task holds is bounded whatever the
   benchmark's size. The same benchmark may be searched in any number of blocks with the same result.
3. In a segment, a window whose terms aren't all there is dropped. For the rest, the list of the rarest term
   is shifted by its offset and intersected with the shifted lists of the others, rarest first. Places that
   are left in every list, inside one document, are exact phrase matches.
4. Proximity matches: places where every word of the window stands within `slop` words of where it should.

Terms are known by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkgrid.llm.common import small_batches, stored, tidy, without

SEGMENT, BLOCK, SLOP = 4 << 20, 200_000, 3
#: Most candidate places that are intersected at once.
AT_ONCE = 2_000_000
#: Segments that are handed to Python at once.
FEW = 2

#: Bytes to words: A-Z to a-z, other ASCII but digits and letters to a space.
_FLAT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_SEGMENT_ROW = "seg long, doc_ids array<long>, doc_keys array<long>, begins array<int>, terms binary, starts binary, places binary"
_ABSENT = np.int64(1) << 40


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FLAT).split()


class Terms:
    """Words to 64-bit hashes, remembered up to `most` words."""

    def __init__(self, most: int = 150_000) -> None:
        self.most, self.known = most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _pack(x: np.ndarray) -> bytes:
    """Integers, compressed: all low bytes first."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def postings(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, starts, places): distinct tokens, sorted; places[starts[i]:starts[i + 1]] are those of terms[i]."""
    terms, back, count = np.unique(tokens, return_inverse=True, return_counts=True)
    return terms, np.concatenate([[0], np.cumsum(count)]).astype(np.int32), np.argsort(back, kind="stable").astype(np.int32)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, doc_key, text) to segments."""
    hashed, number = Terms(), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32

    def row(docs: list) -> pa.RecordBatch:
        tokens = np.concatenate([d[2] for d in docs])
        terms, starts, places = postings(tokens)
        begins = np.concatenate([[0], np.cumsum([len(d[2]) for d in docs])])
        steps = np.diff(places, prepend=np.int32(0)).astype(np.int32)
        values = [[number], [[d[0] for d in docs]], [[d[1] for d in docs]], [begins], [_pack(terms)], [_pack(starts)], [_pack(steps)]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.binary()] * 3]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in _SEGMENT_ROW.split(", ")])

    held, size = [], 0
    for batch in batches:
        for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            words = words_of(text.as_py())
            held.append((doc, key, hashed(words)))
            size += sum(map(len, words)) + len(words)
            if size >= SEGMENT or len(held) >= 1 << 16:
                yield row(held)
                held, size, number = [], 0, number + 1
    if held:
        yield row(held)


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of `docs` (doc_id, doc_key, text): a row for each segment."""
    return stored(docs.select("doc_id", "doc_key", "text").mapInArrow(_index, _SEGMENT_ROW), "postings")


class Segment:
    """One segment's postings, ready to be searched."""

    def __init__(self, begins: np.ndarray, terms: np.ndarray, starts: np.ndarray, places: np.ndarray) -> None:
        self.begins, self.terms, self.starts = begins.astype(np.int64), terms, starts.astype(np.int64)
        rank = np.repeat(np.arange(len(terms), dtype=np.int64), np.diff(self.starts))
        self.places = places.astype(np.int64)
        self.keys = rank << 32 | self.places  # every list, one after another, in order

    def _in_list(self, rank: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a term's list has a place in low..high."""
        at = np.searchsorted(self.keys, rank << 32 | np.maximum(low, 0))
        there = self.keys[np.minimum(at, len(self.keys) - 1)]
        return (at < len(self.keys)) & (there <= (rank << 32 | np.maximum(high, 0))) & (high >= low)

    def search(self, terms: np.ndarray, windows: np.ndarray, slop: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
        """(window, document, start, exact) arrays. `windows` holds places in the sorted `terms`, -1 past the end."""
        if not len(self.keys) or not len(windows):
            return
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        rank = np.where(self.terms[at] == terms, at, -1)
        own = np.where(windows >= 0, rank[windows], -2)
        which = np.flatnonzero((own != -1).all(axis=1))
        own = own[which]
        size = (own >= 0).sum(axis=1)
        count = np.where(own >= 0, self.starts[own + 1] - self.starts[own], _ABSENT)
        order = np.argsort(count, axis=1, kind="stable")
        n = np.take_along_axis(count, order[:, :1], axis=1)[:, 0]
        chunk = np.cumsum(n) // AT_ONCE
        for c in np.unique(chunk):
            part = np.flatnonzero(chunk == c)
            win = np.repeat(part, n[part])
            offset = order[win, 0]
            list_start = self.starts[own[win, offset]]
            place = self.places[list_start + np.arange(len(win)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])]
            doc = np.searchsorted(self.begins, place, side="right") - 1
            yield from self._exact(which, own, order, size, win, doc, place - offset)
            if slop:
                yield from self._near(which, own, order, size, win, doc, place, offset, slop)

    def _exact(self, which, own, order, size, win, doc, start):
        fits = (start >= self.begins[doc]) & (start + size[win] <= self.begins[doc + 1])
        win, doc, start = win[fits], doc[fits], start[fits]
        for k in range(1, own.shape[1]):
            j = order[win, k]
            rank = own[win, j]
            hit = (rank < 0) | self._in_list(np.maximum(rank, 0), start + j, start + j)
            win, doc, start = win[hit], doc[hit], start[hit]
            if not len(win):
                return
        yield which[win], doc, start, True

    def _near(self, which, own, order, size, win, doc, place, offset, slop):
        many = size[win] > 1
        win, doc, place, offset = win[many], doc[many], place[many], offset[many]
        j = order[win, 1]  # a cheap test first: the second rarest, wherever the window may start
        mid = place - offset + j
        hit = self._in_list(own[win, j], np.maximum(mid - 2 * slop, self.begins[doc]), np.minimum(mid + 2 * slop, self.begins[doc + 1] - 1))
        win, doc, start = win[hit], doc[hit], (place - offset)[hit]
        shift = np.arange(-slop, slop + 1)
        win, doc, start = np.repeat(win, len(shift)), np.repeat(doc, len(shift)), (start[:, None] + shift).ravel()
        fits = (start >= self.begins[doc]) & (start + size[win] <= self.begins[doc + 1])
        win, doc, start = win[fits], doc[fits], start[fits]
        same = np.ones(len(win), bool)
        for k in range(own.shape[1]):
            j = order[win, k]
            rank = own[win, j]
            mid = start + j
            hit = (rank < 0) | self._in_list(np.maximum(rank, 0), np.maximum(mid - slop, self.begins[doc]), np.minimum(mid + slop, self.begins[doc + 1] - 1))
            same = same[hit] & ((rank < 0) | self._in_list(np.maximum(rank, 0), mid, mid))[hit]
            win, doc, start = win[hit], doc[hit], start[hit]
            if not len(win):
                return
        found = np.unique(np.stack([win, doc, start], axis=1)[~same], axis=0)
        if len(found):
            yield which[found[:, 0]], found[:, 1], found[:, 2], False


def _search(block, slop: int | None):
    """Segments to (seg, doc, window, first, last, exact), places counted from the document's start."""
    names = ["seg", "doc", "window", "first", "last", "exact"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, windows, ids = block.value
        size = (windows >= 0).sum(axis=1)
        for batch in batches:
            for i in range(batch.num_rows):
                seg, begins, *packed = (batch.column(c)[i].as_py() for c in ("seg", "begins", "terms", "starts", "places"))
                places = np.cumsum(_unpack(packed[2], np.int32), dtype=np.int64)
                s = Segment(np.array(begins), _unpack(packed[0], np.uint64), _unpack(packed[1], np.int32), places)
                for win, doc, start, exact in s.search(terms, windows, slop):
                    first = start - s.begins[doc]
                    columns = [np.full(len(win), seg), doc, ids[win], first, first + size[win] - 1]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([exact] * len(win), pa.bool_())], names=names)

    return run


def _cut(size: int):
    """Items to rows (item_id, window, terms): a hash that names the window, and its words' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Terms()
        for batch in batches:
            items, names, terms = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w = hashed(words_of(text.as_py()))
                for at in range(max(1, len(w) - size + 1) if len(w) else 0):
                    own = w[at : at + size]
                    items.append(item), terms.append(own.view(np.int64))
                    names.append(xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(names, pa.int64()), pa.array(terms, pa.list_(pa.int64()))], names=["item_id", "window", "terms"])

    return run


def _block(rows: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted terms, windows as places in them, window names)."""
    column = rows.column("terms").combine_chunks()
    length = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    terms, back = np.unique(flat, return_inverse=True)
    windows = np.full((len(length), size), -1, np.int64)
    row = np.repeat(np.arange(len(length)), length)
    windows[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = back
    return terms, windows, rows.column("window").to_numpy()


def find(index: DataFrame, benchmark: DataFrame, size: int, slop: int | None, block: int) -> DataFrame:
    """(seg, doc, item_id, window, first, last, exact): where items' windows are in the index."""
    spark = index.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    cut = stored(items.mapInArrow(_cut(size), "item_id long, window long, terms array<long>"), "windows")
    distinct = stored(cut.groupBy("window").agg(F.first("terms").alias("terms")), "windows")
    blocks = max(1, math.ceil(distinct.count() / block))
    hits = None
    with small_batches(spark, FEW):
        for b in range(blocks):
            rows = distinct.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b).toArrow()
            own = spark.sparkContext.broadcast(_block(rows, size))
            found = stored(index.select("seg", "begins", "terms", "starts", "places").mapInArrow(_search(own, slop), "seg long, doc long, window long, first long, last long, exact boolean"), "hits")
            own.unpersist()
            hits = found if hits is None else hits.unionByName(found)
    return hits.join(cut.select("window", "item_id").distinct(), "window")


def documents_of(index: DataFrame) -> DataFrame:
    """(seg, doc, doc_id, doc_key, n_words): a row for each document of the index."""
    lengths = F.transform(F.slice("begins", 2, F.size("begins")), lambda x, i: x - F.get(F.col("begins"), i))
    each = index.select("seg", F.posexplode(F.arrays_zip("doc_ids", "doc_keys", lengths.alias("n_words"))).alias("doc", "d"))
    return each.select("seg", F.col("doc").cast("long").alias("doc"), F.col("d.doc_ids").alias("doc_id"), F.col("d.doc_keys").alias("doc_key"), F.col("d.n_words").cast("long").alias("n_words"))


def _texts(docs: DataFrame) -> DataFrame:
    """With the id, a hash of the text names a row, so that rows which share an id stay apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("doc_key"), text.alias("text"))


def _covered(hits: DataFrame, by: list[str]) -> DataFrame:
    """Spans (first, last) with `fresh`, the words that no span before them in order covers."""
    order = Window.partitionBy(*by).orderBy("first", "last")
    seen = hits.select(*by, "first", "last").distinct().withColumn("past", F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return seen.withColumn("fresh", F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, F.coalesce("past", F.lit(-1)))))


def matches(docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = SLOP, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, first, last, kind): word spans of documents that hold an item's words.

    kind is `exact` (a longest span in which windows of the item lie side by side or overlap) or `near` (for an
    item with places where each word of a window of two words or more stands within `slop` words of its place in
    the document but not all in it: from the first such place to the last word of the last one). Null ids and
    items, empty texts and repeated rows are as in contamination(); repeated rows give equal spans once.
    """
    with tidy() as kept:
        index = build_index(_texts(docs))
        hits = stored(find(index, benchmark, size, slop, block), "hits")
        by = ["seg", "doc", "item_id"]
        order = Window.partitionBy(*by).orderBy("first", "last")
        runs = _covered(hits.where("exact"), by).withColumn("island", F.sum(F.when(F.col("first") <= F.col("past") + 1, 0).otherwise(1)).over(order))
        spans = runs.groupBy(*by, "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island").withColumn("kind", F.lit("exact"))
        near = hits.where("NOT exact").groupBy(*by).agg(F.min("first").alias("first"), F.max("last").alias("last")).withColumn("kind", F.lit("near"))
        named = spans.unionByName(near).join(documents_of(index).select("seg", "doc", "doc_id"), ["seg", "doc"])
        return kept(stored(named.select("doc_id", "item_id", "first", "last", "kind").distinct(), "matches"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, block: int = BLOCK, slop: int | None = SLOP) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    A window is `size` consecutive words of an item, or all of a shorter item's. A document word is hit if
    it lies in an occurrence of a window. n_near counts the items with a proximity match (see matches; null if
    slop is None or 0) and no exact one: leads to look at, which mark nothing. Null and empty texts have no
    words, so nothing hits them and an item without words hits nothing. Null ids are kept, rows that share an id
    are judged each by its own text, repeated rows stay repeated, repeated items count once. Other columns are
    ignored. With an empty benchmark nothing is hit; empty documents give no rows.
    """
    return _judged(docs, benchmark, size, block, slop).drop("doc_key")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, whole, that contamination() does not mark, each by its own id and text, with or
    without an id. Null and empty texts stay; so does everything with an empty benchmark."""
    gone = _judged(docs, benchmark, 10, BLOCK, None).where("contaminated").select("doc_id", "doc_key")
    return without(docs, gone, [F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))])


def _judged(docs: DataFrame, benchmark: DataFrame, size: int, block: int, slop: int | None) -> DataFrame:
    """contamination() with doc_key, the hash of the row's text."""
    with tidy() as kept:
        index = build_index(_texts(docs))
        hits = stored(find(index, benchmark, size, slop, block), "hits")
        doc = ["seg", "doc"]
        n_hit = _covered(hits.where("exact"), doc).groupBy(*doc).agg(F.sum("fresh").alias("n_hit"))
        by_item = hits.groupBy(*doc, "item_id").agg(F.max("exact").alias("exact"))
        items = by_item.groupBy(*doc).agg(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("item_id").cast("string")))).alias("items"), F.sum(F.when(F.col("exact"), 0).otherwise(1)).alias("n_near"))
        rows = documents_of(index).join(n_hit, doc, "left").join(items, doc, "left")
        near = F.coalesce("n_near", F.lit(0)).cast("long") if slop else F.lit(None).cast("long")
        out = rows.select(
            "doc_id", "doc_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), near.alias("n_near"),
        )
        return kept(stored(out, "contamination"))
