import random

from helpers import DOCS, leaks, near_leaks, rows
from pyspark.sql import functions as F

from talkgrid.llm.decontaminate import contamination, matches


def corpus():
    rng = random.Random(1)
    pick = lambda n: [rng.choice(["the", "of", "and"]) if rng.random() < 0.5 else f"w{rng.randrange(400)}" for _ in range(n)]
    items = [(i, " ".join(pick(rng.choice([3, 9, 10, 11, 30])))) for i in range(30)] + [(30, None), (31, "!!"), (32, "zz"), (3, None), (33, "the the the the the the the the the the the")]
    docs = [(1, None), (2, ""), (3, "... !"), (None, items[0][1]), (5, "ZZ, zz; the"), (6, "the " * 40)]
    for i in range(10, 120):
        w = pick(60)
        if i % 3 == 0:
            text = items[i % 30][1].split()
            cut = rng.randrange(0, 3)
            w[20:20] = text[cut:]
            if i % 2:
                w[20:20] = items[(i + 7) % 30][1].upper().split()
        docs.append((i, (", " if i % 5 == 0 else " ").join(w)))
    return docs + [docs[12], (12, "another text of the same id")], items


def test_contamination_matches_brute_force(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], DOCS).withColumns({"item_id": F.lit(7), "n_hit": F.lit("x")})
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = leaks(docs, items)
    assert rows(contamination(d, b).drop("n_near")) == want
    assert rows(contamination(d, b, block=40, slop=None).drop("n_near")) == want  # the benchmark in several blocks


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination(d.limit(0), b).count() == 0
    assert [r.n_hit for r in contamination(d, b.limit(0)).collect()] == [0]
    assert [r.n_hit for r in contamination(d, b).collect()] == [2]


def test_proximity_matches_brute_force(spark):
    rng = random.Random(7)
    pick = lambda n: [f"w{rng.randrange(12)}" for _ in range(n)]
    items = [(i, " ".join(pick(rng.choice([2, 4, 6])))) for i in range(12)] + [(20, None), (21, "w1")]
    docs = [(i, " ".join(pick(rng.randrange(0, 25)))) for i in range(60)] + [(60, None), (61, "w1 w2")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size, slop in ((4, 1), (5, 2)):
        got = {r.doc_id: r.n_near for r in contamination(d, b, size=size, block=7, slop=slop).collect()}
        assert [got[i] for i, _ in docs] == near_leaks(docs, items, size, slop)


def test_long_texts_common_words_and_repeated_items(spark):
    item = "the of the of the of the of the of the"
    docs = [(1, "the of " * 30_000), (2, "of the " * 9), (None, "the of " * 20), (None, "the of " * 20)]
    items = [(1, item), (1, item), (2, item), (3, "of")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(contamination(d, b).drop("n_near")) == leaks(docs, items)


def test_matches_are_spans_and_near_ones_lie_within_the_slop(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs = [(1, f"x y {item} z"), (2, item.replace("delta", "delta new words")), (3, "beta alpha"), (4, "nothing"), (5, f"{item} and then {item}"), (5, f"{item} and then {item}")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")
    exact = {(r.doc_id, r.first, r.last) for r in matches(d, b, slop=3).where("kind = 'exact'").collect()}
    assert exact == {(1, 2, 12), (5, 0, 10), (5, 13, 23)}
    near = {(r.doc_id, r.item_id) for r in matches(d, b, slop=3).where("kind = 'near'").collect()}
    assert (2, 9) in near and not {3, 4} & {i for i, _ in near}
