"""MinHash near-duplicate groups with odd sketches.

A document's set is its distinct word shingles. One Arrow pass over the texts makes, for each
document, a 128-bit fingerprint of the set, `K` MinHash samples folded into an odd sketch (a parity
bitmap) and the keys of its bands. Documents with equal fingerprints are one class, so only class
representatives go on:

1. In each band bucket every member is paired with the bucket's smallest id, never with all others.
2. The XOR population count of two odd sketches estimates the similarity; pairs far below the
   threshold go. The margin is five standard errors of the estimate.
3. What stays is confirmed on full shingle sets, and links become components (large star, small star).
4. Buckets that still hold several components are searched for links *across* components, in blocks
   of bounded size, again by sketch and then by full sets. So no link between components is lost.

Bands of 5 samples (25 of them) serve thresholds from 0.85 on, bands of 4 (32) lower ones. A pair at 0.85
shares no bucket with probability (1 - 0.85**5)**25 = 4e-7, one at 0.8 with (1 - 0.8**4)**32 = 5e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrid.llm.common import bitmap_of, discard, is_marked, one_row_each, small_batches, stored, tidy, without

K, BITS = 128, 1024
#: Most members of a bucket block that are held against another block at once.
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000
#: Rows that carry whole shingle sets are handed to Python so many at a time.
LARGE_ROWS = 256

FEATURES = "doc_id long, n_shingles long, fp binary, bands array<long>, sketch binary"


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240601)
    return rng.integers(0, 2**32, n, dtype=np.uint32), rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


XOR, MUL = _seeds(K)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Texts to sorted arrays of 64-bit shingle hashes."""

    def __init__(self, width: int, most_words: int = 150_000) -> None:
        self.width, self.most, self.known = width, most_words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - self.width + 1)
        x = np.full(n, min(len(h), self.width), np.uint64)
        for i in range(min(len(h), self.width)):
            x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
        return np.unique(x)


def signature(shingles: np.ndarray) -> np.ndarray:
    """K MinHash samples of a set that isn't empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(K, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(least, ((x[None, at : at + 2048] ^ XOR[:, None]) * MUL[:, None]).min(axis=1), out=least)
    return least


def odd_sketch(least: np.ndarray) -> bytes:
    """The samples (i, value) thrown at BITS cells; a cell holds the parity of its count."""
    at = _mix(least.astype(np.uint64) + (np.arange(K, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=BITS).astype(np.uint8) & 1).tobytes()


def band_rows(percent: int) -> int:
    return 5 if percent >= 85 else 4


def band_keys(least: np.ndarray, wide: int) -> np.ndarray:
    bands = K // wide
    rows = least[: bands * wide].reshape(bands, wide).astype(np.uint64)
    x = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(wide):
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return x.view(np.int64)


def most_odd_bits(threshold: float) -> int:
    """Largest XOR count kept: that of a similarity five standard errors below the threshold."""
    j = threshold - 5 * (threshold * (1 - threshold) / K) ** 0.5
    return int(np.ceil(BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * K * (1 - j)))))


def _features(width: int, wide: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            ns, fps, bands, sketches = [], [], [], []
            for text in batch.column(1):
                x = shingle(text.as_py())
                ns.append(len(x))
                if len(x):
                    least = signature(x)
                    fps.append(xxhash.xxh3_128_digest(x.tobytes()))
                    bands.append(band_keys(least, wide))
                    sketches.append(odd_sketch(least))
                else:
                    fps.append(None), bands.append(None), sketches.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(fps, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                names=["doc_id", "n_shingles", "fp", "bands", "sketch"],
            )

    return run


def _near(percent: int):
    """Rows (a, b, sa, sb) to the (a, b) whose sets have 100 * |intersection| >= percent * |union|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for sa, sb in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(sa.as_py(), np.uint64), np.frombuffer(sb.as_py(), np.uint64)
                few, many = sorted((len(x), len(y)))
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * few >= percent * many else 0
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return run


def _close_by_sketch(most: int):
    """Rows (a, b, ka, kb) to the (a, b) whose odd sketches differ in `most` bits at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            both = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(n, BITS // 64) for c in ("ka", "kb")]
            mask = pa.array(np.bitwise_count(both[0] ^ both[1]).sum(axis=1) <= most)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return run


def _across(most: int, percent: int):
    """Sorted bucket rows (cell, band, side, doc_id, comp, sketch, bands, shingles) to links that join different
    components. A cell holds two blocks of bounded size. A pair is looked at in its first common band only;
    once two components are joined, their other pairs are passed over, so a cell emits fewer links than rows."""

    def links(band: int, rows: list) -> Iterator[pa.RecordBatch]:
        side, ids = (np.array([r[i] for r in rows]) for i in (0, 1))
        label = np.unique([r[2] for r in rows], return_inverse=True)[1]
        bits = np.frombuffer(b"".join(r[3] for r in rows), np.uint64).reshape(len(rows), BITS // 64)
        keys = np.array([r[4] for r in rows], np.int64)
        sets = [np.frombuffer(r[5], np.uint64) for r in rows]
        size = np.array([len(x) for x in sets])
        one = side[0] == side[-1]  # a block held against itself
        left = np.arange(len(rows)) if one else np.flatnonzero(side == side[0])
        right = left if one else np.flatnonzero(side != side[0])
        a, b = [], []
        for i in left:
            near = right[(label[right] != label[i]) & (right > i if one else True)]
            near = near[100 * np.minimum(size[near], size[i]) >= percent * np.maximum(size[near], size[i])]
            near = near[np.bitwise_count(bits[near] ^ bits[i]).sum(axis=1) <= most]
            near = near[(keys[near] == keys[i]).argmax(axis=1) == band] if len(near) else near
            while len(near):
                some, near = near[:64], near[64:]
                flat = np.concatenate([sets[j] for j in some])
                at = np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)
                both = np.add.reduceat((sets[i][at] == flat).astype(np.int64), np.cumsum(size[some]) - size[some])
                for j in some[100 * both >= percent * (size[some] + size[i] - both)]:
                    if label[j] != label[i]:
                        a.append(ids[i]), b.append(ids[j])
                        label[label == label[j]] = label[i]
                near = near[label[near] != label[i]]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, band, rows = None, 0, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("cell", "band", "side", "doc_id", "comp", "sketch", "bands", "shingles")]
            for c, k, *row in zip(*columns, strict=True):
                if c != cell and rows:
                    yield from links(band, rows)
                    rows = []
                cell, band = c, k
                rows.append(row)
        if rows:
            yield from links(band, rows)

    return run


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, comp) for every id in `edges` (a, b): comp is the smallest id reachable. Large star and small
    star in turn, each an aggregation and a join back, until nothing changes; never on the driver."""
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are stored, as Spark splits a hot key only where both sides of a join are plain exchanges
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")
        large = stored(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        hung = large.join(least, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = stored(small, "edges")
        for old in (low, large, least):
            discard(old)
        mark = tuple(after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())
        discard(now)
        now = after
        if mark == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
        before = mark
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_groups(docs: DataFrame, width: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    Linked: sets of `width`-word shingles with 100 * intersection >= percent * union. Words are runs of
    other than ASCII white space, A-Z lower-cased; a text of fewer words is one shingle; one without words
    (or null) has an empty set and no link. Rows with one id are one document, so they share a component.
    A null id names no document: component_id is null and the row is kept. Repeated rows stay repeated;
    `kept` marks every row whose id is its component's. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with tidy() as kept:
        return kept(stored(_grouped(texts, width, percent), "near-groups"))


def _grouped(texts: DataFrame, width: int, percent: int) -> DataFrame:
    spark = texts.sparkSession
    feats = stored(texts.mapInArrow(_features(width, band_rows(percent)), FEATURES), "features")
    full = feats.where("n_shingles > 0 AND doc_id IS NOT NULL")
    slim = full.select("doc_id", "fp")
    # what a hot fingerprint or bucket joins is stored first, so that Spark can split the hot key
    first = stored(slim.groupBy("fp").agg(F.min("doc_id").alias("rid")), "prints")
    member = stored(slim.join(first, "fp").select("doc_id", "rid").distinct(), "members")
    lead = stored(full.select("doc_id", "n_shingles", "bands", "sketch").join(member.where("doc_id = rid").select("doc_id"), "doc_id", "left_semi"), "leaders")
    cards = lead.select("doc_id", "sketch", "bands")

    bands = lead.select("doc_id", F.posexplode("bands").alias("band", "key"))
    heads = stored(bands.groupBy("key").agg(F.min("doc_id").alias("head"), F.count("*").alias("size")).where("size > 1"), "heads")
    shared = stored(bands.join(heads, "key"), "buckets")
    discard(first), discard(heads)
    stars = shared.where("doc_id != head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
    with small_batches(spark, LARGE_ROWS), tidy() as kept:
        links = kept(stored(_confirmed(stars, cards, texts, width, percent), "links"))

    many = member.groupBy("doc_id").agg(F.min("rid").alias("a"), F.max("rid").alias("_m")).where("a < _m")
    same = member.join(many, "doc_id").where("rid != a").select("a", F.col("rid").alias("b"))
    with tidy() as kept:
        comp = kept(stored(components(links.unionByName(same)), "components"))

    labelled = shared.where("size > 2").select("key", "band", "doc_id").join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    weighed = labelled.join(lead.select("doc_id", "n_shingles"), "doc_id")
    mixed = weighed.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count("*").alias("_n"), F.sum("n_shingles").alias("_s")).where("_lo < _hi")
    blocks = F.greatest(F.ceil(F.col("_n") / BLOCK), F.ceil(F.col("_s") / BLOCK_SHINGLES)).cast("int")
    mixed = stored(mixed.select("key", blocks.alias("_p")), "crowded")
    held = stored(labelled.join(mixed, "key"), "mixed")
    discard(shared), discard(mixed)
    with small_batches(spark, LARGE_ROWS), tidy() as kept:
        sets = _sets_of(held.select("doc_id").distinct(), texts, width)
        cells = (
            held.withColumn("side", F.pmod(F.xxhash64("doc_id"), F.col("_p")).cast("int"))
            .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_p") - 1)))
            .select(F.xxhash64("key", F.least("side", "_o"), F.greatest("side", "_o")).alias("cell"), "band", "side", "doc_id", "comp")
            .join(stored(cards.join(sets, "doc_id"), "cards"), "doc_id")
        )
        cross = cells.repartition("cell").sortWithinPartitions("cell", "side", "doc_id").mapInArrow(_across(most_odd_bits(percent / 100), percent), "a long, b long")
        more = kept(stored(cross.distinct(), "links"))
    if more.isEmpty():
        final = comp
    else:
        name = comp.select(F.col("id").alias("a"), F.col("comp").alias("ca"))
        lifted = stored(more.join(name, "a", "left").join(name.select(F.col("a").alias("b"), F.col("ca").alias("cb")), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "links")
        merged = stored(components(lifted).withColumnRenamed("id", "c0").withColumnRenamed("comp", "c1"), "components")
        nodes = comp.unionByName(lifted.select(F.explode(F.array("a", "b")).alias("id")).select("id", F.col("id").alias("comp")).distinct()).distinct()
        nodes = stored(nodes.groupBy("id").agg(F.min("comp").alias("c0")), "nodes")
        final = nodes.join(merged, "c0", "left").select("id", F.coalesce("c1", "c0").alias("comp"))
    own = stored(member.groupBy("doc_id").agg(F.min("rid").alias("rid")), "representatives")
    head = own.join(stored(final.withColumnRenamed("id", "rid"), "components"), "rid", "left").select("doc_id", F.coalesce("comp", "rid").alias("_c"))
    return (
        feats.select("doc_id", "n_shingles").join(head, "doc_id", "left")
        .withColumn("component_id", F.coalesce(F.least("_c", "doc_id"), "doc_id"))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def one_of_each(docs: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, whole, that near_groups keeps; of rows that share an id one, the first by a hash of
    the row. Rows without an id stay, and so do null and empty texts (with an id, in one row each)."""
    groups = near_groups(docs, width, percent, id_col, text_col)
    stay = without(docs, groups.where("NOT kept").select("doc_id").distinct(), [F.col(id_col).cast("long")])
    again = groups.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    return one_row_each(stay, again, F.col(id_col).cast("long")).select(docs.columns)


def _sets_of(wanted: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles) of the wanted documents. A bitmap of their hashed ids, of bounded size, spares most
    other texts the tokenising and the shuffle; a join then lets just the wanted pass."""
    bitmap, bits = bitmap_of(wanted.select(F.xxhash64("doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            mask = pa.array(is_marked(bitmap.value, batch.column(2).to_numpy(zero_copy_only=False)))
            ids, text = batch.column(0).filter(mask), batch.column(1).filter(mask)
            yield pa.RecordBatch.from_arrays([ids, pa.array([shingle(t.as_py()).tobytes() for t in text], pa.binary())], names=["doc_id", "shingles"])

    found = texts.where("doc_id IS NOT NULL").withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(bits))).mapInArrow(run, "doc_id long, shingles binary")
    return stored(found.join(wanted, "doc_id", "left_semi"), "sets")


def _confirmed(pairs: DataFrame, cards: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose sketches and then full sets are near enough."""
    k = cards.select(F.col("doc_id").alias("a"), F.col("sketch").alias("ka"))
    m = cards.select(F.col("doc_id").alias("b"), F.col("sketch").alias("kb"))
    close = pairs.join(m, "b").join(k, "a").mapInArrow(_close_by_sketch(most_odd_bits(percent / 100)), "a long, b long")
    pairs = stored(close.distinct(), "pairs")
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), texts, width)
    sa = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    sb = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(sb, "b").join(sa, "a").mapInArrow(_near(percent), "a long, b long").distinct()
