import math
import random
from collections import Counter, defaultdict

import numpy as np
from helpers import DOCS, runs
from pyspark.sql import functions as F

from talkgrid.llm import quality_rules as q


def brute_base(text):
    text = text or ""
    w = runs(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if runs(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(again)


def texts():
    rng = random.Random(3)
    out = [None, "", " \n", "a", "é ü x", "one two three four five one two three four five", "a a a a a a", "a a a a a", "x\nx\n x\n\n\nx", "#*$%&|<> ok"]
    for _ in range(60):
        w = [rng.choice(["la", "le", "né", "tion", "mo", "%%", "x|y"]) for _ in range(rng.randrange(1, 120))]
        out.append("".join(x + rng.choice([" ", " ", "\n", "\t"]) for x in w))
    return out


def test_base_counts_match_brute_force():
    for t in texts():
        assert q.base_counts(t) == brute_base(t), t


def brute_model(docs):
    """log p of every byte of every document: interpolated modified Kneser-Ney, by dictionaries."""
    counts = {n: defaultdict(Counter) for n in range(1, q.ORDER + 1)}
    padded = [(g, b"\0" * (q.ORDER - 1) + (t or "").encode()) for g, t in docs]
    top = Counter((g, b[i - q.ORDER + 1 : i + 1]) for g, b in padded for i in range(q.ORDER - 1, len(b)))
    level = {q.ORDER: top}
    for n in range(q.ORDER - 1, 0, -1):
        level[n] = Counter((g, x[1:]) for g, x in level[n + 1])
    for n, c in level.items():
        for (g, x), k in c.items():
            counts[n][g, x[:-1]][x[-1:]] = k
    of = {(n, g): Counter(k for (h, _), k in level[n].items() if h == g) for n in level for g, _ in docs}

    def p(g, n, x):
        if n == 0:
            return 1 / 257
        d = q.discounts({(n, 0, k): v for k, v in of[n, g].items()}, n, 0)
        own = counts[n][g, x[:-1]]
        total = sum(own.values())
        cut = lambda k: d[min(k, 3) - 1] if k else 0
        k = own.get(x[-1:], 0)
        return max(0, k - cut(k)) / total + sum(map(cut, own.values())) / total * p(g, n - 1, x[1:])

    def own(g, n, x):
        """A count of one is the text's own: as unseen."""
        if n == 0:
            return 1 / 257
        c = counts[n][g, x[:-1]]
        if c[x[-1:]] > 1:
            return p(g, n, x)
        d = q.discounts({(n, 0, k): v for k, v in of[n, g].items()}, n, 0)
        left = sum(d[min(k, 3) - 1] for k in c.values() if k) / sum(c.values()) if sum(c.values()) > 1 else 1
        return left * own(g, n - 1, x[1:])

    return [sum(math.log(own(g, q.ORDER, b[i - q.ORDER + 1 : i + 1])) for i in range(q.ORDER - 1, len(b))) for g, b in padded]


def test_perplexities_match_brute_force_in_one_shard_and_in_many(spark):
    docs = [(i, t, ("en", "fr", None)[i % 3]) for i, t in enumerate(texts())]
    df = spark.createDataFrame([(i, t, g, "s", 1) for i, t, g in docs] + [(5, docs[5][1], docs[5][2], "s", 1)], DOCS)
    all_docs = docs + [docs[5]]
    want = brute_model([(g, t) for _, t, g in all_docs])
    exact = {i: -w / max(1, len((t or "").encode())) for (i, t, _), w in zip(all_docs, want, strict=True)}
    for shard in (q.SHARD, 300):
        got = {r.doc_id: r.log_ppl for r in q.perplexities(df, shard).collect()}
        for i, t, _ in docs:
            if t:
                assert math.isclose(got[i], exact[i], rel_tol=1e-4), (shard, i)
            else:
                assert got[i] is None


def test_back_off_scores_unseen_text_and_sums_to_one(spark):
    df = spark.createDataFrame([(1, "abracadabra abracadabra", "en")], "doc_id long, text string, lang string")
    model = q.KneserNey(df).part(0, own=False)
    head = b"zzab"
    data = np.frombuffer(b"".join(head + bytes([c]) for c in range(256)), np.uint8)
    codes = q.ngram_codes(data, np.arange(0, len(data) + 1, 5), np.full(256, q.lang_code("en")))[4::5]
    assert abs(np.exp(model(codes)).sum() - 256 / 257) < 0.02


def test_verdicts(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["la", "le", "mo", "tion", "re"]) for _ in range(rng.randrange(1, 4)))
    docs = [(i, " ".join(word() for _ in range(200)), "en") for i in range(60)] + [(100, "".join(chr(33 + rng.randrange(90)) + (" " if rng.random() < 0.1 else "") for _ in range(1500)), "en"), (101, "too short", "en"), (102, "a b c d e f g h " * 30, "en"), (103, None, None), (None, "", "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"low": F.lit(1), "_q": F.lit(2), "n_words": F.lit("x")})
    got = {r.doc_id: r for r in q.quality(df).collect()}
    assert all(got[i].kept for i in range(60))
    assert not got[100].base_failed and not got[100].kept  # noise: over the upper band
    assert all(got[i].base_failed and not got[i].kept for i in (101, 102, 103, None))
    assert q.quality(df.limit(0)).count() == 0
