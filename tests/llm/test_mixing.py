import hashlib
import math
import random
from collections import Counter, defaultdict

from helpers import DOCS, runs
from pyspark.sql import functions as F

from talkgrid.llm import mixing as m


def brute(docs, budget=1.0, entropy=0.97, repeats=4.0):
    rows = [(i, s, len(runs(t))) for i, t, s in docs if runs(t)]
    size = Counter()
    for _, s, n in rows:
        size[s] += n
    total = sum(size.values())
    p = {s: n / total for s, n in size.items()}

    def weights(k):
        z = {s: x ** (k / m.GRID) for s, x in p.items()}
        return {s: v / sum(z.values()) for s, v in z.items()}

    flat = [k for k in range(m.GRID + 1) if -sum(w * math.log(w) for w in weights(k).values()) >= entropy * math.log(len(p)) - 1e-9]
    seldom = [k for k in range(m.GRID + 1) if max(weights(k)[s] * budget * total / n for s, n in size.items()) <= repeats + 1e-9]
    k = max(max(flat, default=0), min(seldom, default=m.GRID))
    out = Counter()
    md5 = lambda *x: hashlib.md5("|".join(x).encode()).hexdigest()
    for s, w in weights(k).items():
        due = math.floor(w * budget * total + 1e-6)
        whole, rest = divmod(due, size[s])
        blocks = math.ceil(math.sqrt(size[s]))
        dealt = defaultdict(list)
        for i, own, n in rows:
            if own == s:
                place = md5("mix", "" if i is None else str(i))
                dealt[int(place[:8], 16) % blocks].append((place, i is not None, i or 0, n))
        left = rest
        for b in sorted(dealt, key=lambda b: (md5("mix", "block", s or "", str(b)), b)):
            full = sum(x[3] for x in dealt[b])
            seen = 0
            for _, has, i, n in sorted(dealt[b]):
                seen += n
                for e in range(whole + (left >= full or (left > 0 and seen <= left))):
                    out[(i if has else None, s, n, e + 1)] += 1
            left -= full
    return out, k / m.GRID


def make(seed, sources, n):
    rng = random.Random(seed)
    docs = [(i, " ".join("w" for _ in range(rng.randrange(0, 40))), rng.choice(sources)) for i in range(n)]
    return docs + [(None, "a b", sources[0]), (3, None, "b"), (4, " \n", None), (5, "x y z", None), docs[7]]


def test_mixture_matches_brute_force(spark):
    for docs, kw in ((make(1, ["a"] * 9 + ["b", "c", None], 300), {}), (make(2, ["a"] * 40 + ["b", "c"], 400), {"repeats": 2.0, "entropy": 0.99}), (make(3, ["a", "b"], 200), {"budget": 2.5})):
        df = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in docs], DOCS).withColumns({"weight": F.lit("w"), "place": F.lit(1), "epoch": F.lit(2), "_n": F.lit(1)})
        got = m.mixture(df, **kw).collect()
        want, _ = brute(docs, **kw)
        assert Counter((r.doc_id, r.source, r.n_tokens, r.epoch) for r in got) == want


def test_exponent(spark):
    for seed in range(3):
        docs = make(seed, ["a"] * 20 + ["b"] * 5 + ["c"], 300)
        size = Counter()
        for _, t, s in docs:
            size[s] += len(runs(t))
        table = spark.createDataFrame([(s, n) for s, n in size.items() if n], "source string, tokens long")
        for kw in ({"entropy": 0.97, "repeats": 4.0}, {"entropy": 0.5, "repeats": 1.5}, {"entropy": 1.0, "repeats": 100.0}):
            assert m.exponent(table, float(sum(size.values())), **kw) == brute(docs, 1.0, **kw)[1]


def test_last_true_finds_every_boundary():
    for edge in (*range(0, 70), 4095, 4096):
        assert m._last_true(0, 4096, lambda ks, e=edge: [k <= e for k in ks]) == edge


def test_empty_and_wordless_tables(spark):
    df = spark.createDataFrame([(1, "", "en", "s", 1)], DOCS)
    assert m.mixture(df).count() == 0 and m.mixture(df.limit(0)).count() == 0
