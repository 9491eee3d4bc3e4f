import random

import numpy as np
from helpers import DOCS, near, rows
from pyspark.sql import functions as F

from talkgrid.llm import near_dedup as nd


def vocabulary(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def check(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS)
    assert rows(nd.near_groups(df, **kw)) == near(docs, kw.get("width", 3), kw.get("percent", 85))


def test_groups_match_brute_force_with_edge_rows(spark):
    rng = random.Random(4)
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "Two one"), (None, "one"), (None, None)]
    for i in range(10, 40):
        base = vocabulary(rng, 60)
        docs.append((i, " ".join(base)))
        for j in range(3):  # copies at many distances, across the threshold
            copy = list(base)
            for _ in range(j * 2 + rng.randrange(4)):
                copy[rng.randrange(60)] = "x%d" % rng.randrange(99)
            docs.append((i + 100 * (j + 1), " ".join(copy)))
    docs += [(10, docs[9][1]), (10, "a text of its own for an id that is taken already"), (900, "a text of its own for an id that is taken already")]
    check(spark, docs)


def test_one_large_group_of_near_copies_keeps_chains_and_strangers_apart(spark):
    rng = random.Random(5)
    base = vocabulary(rng, 120)
    docs = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randrange(1, 9)):
            copy[rng.randrange(120)] = f"x{rng.randrange(9999)}"
        docs.append((i, " ".join(copy)))
    check(spark, docs)


def test_blocks_of_a_bucket_find_the_same_links(spark, monkeypatch):
    rng = random.Random(6)
    base = vocabulary(rng, 80)
    docs = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randrange(1, 8)):
            copy[rng.randrange(80)] = f"x{rng.randrange(9999)}"
        docs.append((i, " ".join(copy)))
    monkeypatch.setattr(nd, "BLOCK", 8)
    check(spark, docs)


def test_five_words_and_a_lower_threshold(spark):
    rng = random.Random(7)
    docs = []
    for i in range(20):
        base = vocabulary(rng, 90)
        docs.append((i, " ".join(base)))
        base[rng.randrange(90)] = "new"
        base[rng.randrange(90)] = "other"
        docs.append((100 + i, " ".join(base)))
    check(spark, docs, width=5, percent=80)


def test_empty_table_extra_columns_and_long_text(spark):
    empty = spark.createDataFrame([], DOCS)
    assert nd.near_groups(empty).count() == 0
    long = " ".join(f"t{i}" for i in range(30_000))
    df = spark.createDataFrame([(1, long), (2, long + " tail"), (3, "short text here")], "doc_id long, text string")
    df = df.withColumns({"component_id": F.lit("x"), "rid": F.lit(1), "kept": F.lit(None).cast("boolean"), "key": F.lit(2)})
    assert {r.doc_id: r.component_id for r in nd.near_groups(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(1)
    for share in (0.8, 0.9, 0.97):
        errors = []
        for _ in range(30):
            both, n = rng.integers(0, 2**63, 2000, dtype=np.uint64), int(2000 * (1 - share) / (1 + share))
            a, b = np.concatenate([both[n:], rng.integers(0, 2**63, n, dtype=np.uint64)]), both
            real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            bits = [np.frombuffer(nd.odd_sketch(nd.signature(np.unique(x))), np.uint64) for x in (a, b)]
            odd = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
            errors.append(1 + nd.BITS / (4 * nd.K) * np.log(1 - 2 * odd / nd.BITS) - real)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08
