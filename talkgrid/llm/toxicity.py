"""Toxicity by a bidirectional gated recurrent network with attention pooling over windows of words.

A word enters as two views: a hashed word embedding, and the mean embedding of its character n-grams (of
UTF-8 bytes, with marks for its start and end). Both views also bring a smoothed lower bound of the log
odds with which they occur in toxic rather than clean documents of the learning sample. Windows of `SPAN`
words start every `STRIDE` words, so all words lie in overlapping windows, and every window of a whole
text is scored. A document's probability is calibrated from its two highest windows and its length.

Only documents are labelled, so training is multiple-instance learning: a document stands for its
highest window, found anew as the network learns. The log odds a training document sees leave that
document out, so that inputs look in training as they will on unseen text. The sample is bounded: `SAMPLE`
rows of each label from the learning fold; of a text over `LONGEST` characters, a stretch of `LONGEST` at a
place hashed from its id is learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrid.llm.bigru import Adam, Params, scan, scan_back, softmax
from talkgrid.llm.common import held_out
from talkgrid.llm.decontaminate import words_of
from talkgrid.llm.language_id import sample_by

HIDDEN, SPAN, STRIDE = 8, 24, 12
SAMPLE, LONGEST = {1: 600, 0: 1200}, 30_000
GRAMS, CELLS, WORDS, ROWS, WIDE = (4, 5, 6), 1 << 19, 1 << 17, 1 << 12, 6
DIM = 2 * WIDE + 3
STEPS, BATCH, THRESHOLD = 200, 144, 0.7


def _grams(words: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length, the owner and the hash of every character n-gram of `^word$`."""
    line = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    found = {}
    for n in GRAMS:
        code = np.zeros(max(0, len(line) - n + 1), np.uint64)
        for k in range(n):
            code = code * np.uint64(0x100000001B3) + line[k : k + len(code)] + np.uint64(1)
        whole = owner[: len(code)] == owner[n - 1 : n - 1 + len(code)]
        code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        found[n] = owner[: len(code)][whole], (code ^ (code >> np.uint64(32)))[whole]
    return found


def _word_hash(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def lower_bound(a: np.ndarray, b: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Log odds of a thing in a of `toxic` and b of `clean` documents, less two standard errors; at least 0."""
    a, b = a + 0.3, b + 0.3
    return np.maximum(0, np.log(a / (toxic + 1)) - np.log(b / (clean + 1)) - 2 * np.sqrt(1 / a + 1 / b)).astype(np.float32)


class Words:
    """What the network sees of words: rows of hashed embeddings, and log odds from document counts."""

    def __init__(self, words: list[bytes]) -> None:
        self.n, h = len(words), _word_hash(words)
        self.word_row, self.word_cell = (h % np.uint64(ROWS)).astype(np.int64), (h >> np.uint64(20)).astype(np.int64) % WORDS
        self.parts = []
        for n, (owner, g) in _grams(words).items():
            has, first, count = np.unique(owner, return_index=True, return_counts=True)
            self.parts.append((owner, (g >> np.uint64(20)).astype(np.int64) % CELLS, has, first))
            if n == GRAMS[0]:  # the embedded ones
                self.owner, self.row, self.has, self.first, self.count = owner, (g % np.uint64(ROWS)).astype(np.int64), has, first, count

    def best(self, value) -> np.ndarray:
        """Each word's largest value(cells) over its n-grams."""
        out = np.zeros(self.n, np.float32)
        for _, cell, has, first in self.parts:
            if len(has):
                out[has] = np.maximum(out[has], np.maximum.reduceat(value(cell), first))
        return out

    def mean(self, table: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, table.shape[1]), np.float32)
        if len(self.has):
            out[self.has] = np.add.reduceat(table[self.row], self.first) / self.count[:, None]
        return out

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """All words' n-gram cells, one word after another, and the n + 1 offsets."""
        owner, cell = (np.concatenate([x[i] for x in self.parts]) for i in (0, 1))
        return cell[np.argsort(owner, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=self.n))])

    def inputs(self, p: Params, word_odds: np.ndarray, gram_odds: np.ndarray) -> np.ndarray:
        return np.concatenate([p["word"][self.word_row], self.mean(p["char"]), word_odds[:, None], gram_odds[:, None], np.maximum(word_odds, gram_odds)[:, None] > 1], axis=1).astype(np.float32)


def window_starts(n: int) -> np.ndarray:
    """Where the windows of n words start: every STRIDE words until the last word is covered, one at least."""
    return np.arange(0, max(1, n - SPAN + STRIDE), STRIDE)


def _gather(starts: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """(SPAN, windows) of rows; 0, the empty word, past a document's end."""
    place = starts[None, :] + np.arange(SPAN)[:, None]
    return np.where(place < ends[None, :], ids[np.minimum(place, max(0, len(ids) - 1))] if len(ids) else 0, 0)


def _forward(p: Params, x: dict[str, np.ndarray], live: np.ndarray) -> tuple[np.ndarray, dict]:
    s = {d: scan(x[d], p[f"u{d}"], d == "b") for d in "fb"}
    e = np.where(live, np.einsum("h,thb->tb", p["qf"], s["f"]) + np.einsum("h,thb->tb", p["qb"], s["b"]), np.float32(-30))
    a = softmax(e, axis=0)
    pool = {d: np.einsum("tb,thb->hb", a, s[d]) for d in "fb"}
    return p["vf"] @ pool["f"] + p["vb"] @ pool["b"] + p["c"][0], {"s": s, "a": a, "pool": pool}


def _added(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of values summed by `at`."""
    return np.stack([np.bincount(at, values[:, i], n) for i in range(values.shape[1])], axis=1)


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Newton's method; the last weight is the bias."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (q * (1 - q))[:, None]).T @ x + ridge * len(x) * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (y - q) - ridge * len(x) * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _top(logit: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Calibration inputs (highest, second highest, log of windows) and the highest window, by document.
    Every document has a window, and windows are in document order."""
    first = np.searchsorted(doc, np.arange(n))
    order = np.lexsort((-logit, doc))
    count = np.bincount(doc, minlength=n)
    best = order[first]
    second = np.where(count > 1, logit[order[np.minimum(first + 1, len(order) - 1)]], np.minimum(logit[best], -4))
    return np.stack([logit[best], second, np.log(count)], axis=1), best


def train(texts: list[str], labels: list[int], seed: int = 3, steps: int = STEPS) -> dict:
    """A model from whole texts and their 0/1 labels, both of which must occur."""
    rng = np.random.default_rng(seed)
    docs = [words_of(t) for t in texts]
    y = np.array(labels, bool)
    toxic, clean = int(y.sum()), int((~y).sum())
    names = sorted({w for d in docs for w in d})
    number = {w: i + 1 for i, w in enumerate(names)}
    spelled = [b"", *names]
    words = Words(spelled)
    counts = {k: np.zeros((2, n), np.float32) for k, n in (("word", WORDS), ("gram", CELLS))}
    spread = [np.unique(np.fromiter((number[w] for w in d), np.int64, len(d))) for d in docs]
    cell, begin = words.cells()
    for own, t in zip(spread, y, strict=True):
        g = np.unique(np.concatenate([cell[begin[i] : begin[i + 1]] for i in own])) if len(own) else np.zeros(0, np.int64)
        counts["gram"][int(t), g] += 1
        counts["word"][int(t), np.unique(words.word_cell[own])] += 1
    # each distinct (document, word) is an input row of its own, as it leaves its document out
    rows, word_odds, gram_odds, at = [], [], [], 1
    ids, starts, ends, owner = [], [], [], []
    base = 0
    for k, (d, own, t) in enumerate(zip(docs, spread, y, strict=True)):
        w_cell = words.word_cell[own]
        wa, wb = counts["word"][1, w_cell] - t, counts["word"][0, w_cell] - (not t)
        word_odds.append(lower_bound(wa, wb, toxic - int(t), clean - int(not t)))
        part = [cell[begin[i] : begin[i + 1]] for i in own]
        if part:
            flat = np.concatenate(part)
            value = lower_bound(counts["gram"][1, flat] - t, counts["gram"][0, flat] - (not t), toxic - int(t), clean - int(not t))
            size = np.array([len(x) for x in part])
            some = size > 0
            best = np.zeros(len(part), np.float32)
            if some.any():
                best[some] = np.maximum.reduceat(value, (np.cumsum(size) - size)[some])
            gram_odds.append(best)
        local = {int(i): at + j for j, i in enumerate(own)}
        ids.append(np.fromiter((local[number[w]] for w in d), np.int64, len(d)))
        rows.append(own)
        at += len(own)
        s = window_starts(len(d)) + base
        starts.append(s), ends.append(np.full(len(s), base + len(d))), owner.append(np.full(len(s), k))
        base += len(d)
    row = np.concatenate([[0], *rows]).astype(np.int64)
    word_odds, gram_odds = np.concatenate([[0], *word_odds]).astype(np.float32), np.concatenate([[0], *gram_odds]).astype(np.float32)
    grid = _gather(np.concatenate(starts), np.concatenate(ends), np.concatenate(ids))
    doc = np.concatenate(owner)
    h = HIDDEN
    p: Params = {"word": rng.normal(0, 0.1, (ROWS, WIDE)), "char": rng.normal(0, 0.1, (ROWS, WIDE)), "c": np.array([-1.0])}
    for d in "fb":
        p |= {f"w{d}": rng.normal(0, 0.3, (3 * h, DIM)), f"b{d}": np.zeros(3 * h), f"u{d}": rng.normal(0, 0.3, (3 * h, h)), f"q{d}": rng.normal(0, 0.3, h), f"v{d}": rng.normal(0, 0.3, h)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    adam = Adam(p, 0.02)

    def logits() -> np.ndarray:
        feats = words.inputs(p, np.zeros(words.n, np.float32), np.zeros(words.n, np.float32))[row]
        feats[:, -3], feats[:, -2], feats[:, -1] = word_odds, gram_odds, np.maximum(word_odds, gram_odds) > 1
        table = {d: feats @ p[f"w{d}"].T + p[f"b{d}"] for d in "fb"}
        out = []
        for lo in range(0, grid.shape[1], 4096):
            g = grid[:, lo : lo + 4096]
            out.append(_forward(p, {d: np.ascontiguousarray(table[d][g].transpose(0, 2, 1)) for d in "fb"}, g > 0)[0])
        return np.concatenate(out)

    strength = np.where(grid > 0, np.maximum(word_odds, gram_odds)[grid], 0).max(axis=0)
    best = _top(strength, doc, len(docs))[1]
    pos, neg = np.flatnonzero(y), np.flatnonzero(~y)
    quiet = np.flatnonzero(~y[doc])
    for step in range(steps):
        if step and step % 40 == 0:
            best = _top(logits(), doc, len(docs))[1]
        adam.rate = 0.02 * (1 - 0.9 * step / steps)
        third = BATCH // 3
        pick = np.concatenate([best[rng.choice(pos, third)], best[rng.choice(neg, third)], rng.choice(quiet, BATCH - 2 * third)])
        want = y[doc[pick]].astype(np.float32)
        g = grid[:, pick]
        flat = row[g.ravel()]
        use, back = np.unique(flat, return_inverse=True)
        part = Words([spelled[i] for i in use])
        feats = part.inputs(p, np.zeros(part.n, np.float32), np.zeros(part.n, np.float32))[back]
        o1, o2 = word_odds[g.ravel()], gram_odds[g.ravel()]
        feats[:, -3], feats[:, -2], feats[:, -1] = o1, o2, np.maximum(o1, o2) > 1
        x = {d: np.ascontiguousarray((feats @ p[f"w{d}"].T + p[f"b{d}"]).reshape(SPAN, len(pick), -1).transpose(0, 2, 1)) for d in "fb"}
        live = g > 0
        z, kept = _forward(p, x, live)
        dz = ((1 / (1 + np.exp(-z)) - want) / len(pick)).astype(np.float32)
        grads = {"c": np.array([dz.sum()])}
        da = 0
        for d in "fb":
            grads[f"v{d}"] = kept["pool"][d] @ dz
            da = da + np.einsum("h,thb->tb", p[f"v{d}"], kept["s"][d]) * dz
        a = kept["a"]
        de = np.where(live, a * (da - (a * da).sum(axis=0)), 0).astype(np.float32)
        df = np.zeros_like(feats)
        for d in "fb":
            grads[f"q{d}"] = np.einsum("tb,thb->h", de, kept["s"][d])
            ds = a[:, None, :] * (p[f"v{d}"][:, None] * dz)[None] + de[:, None, :] * p[f"q{d}"][None, :, None]
            dx, grads[f"u{d}"] = scan_back(x[d], p[f"u{d}"], kept["s"][d], ds.astype(np.float32), d == "b")
            dx = dx.transpose(0, 2, 1).reshape(len(flat), -1)
            grads[f"w{d}"], grads[f"b{d}"] = dx.T @ feats, dx.sum(axis=0)
            df += dx @ p[f"w{d}"]
        by_word = _added(back, df[:, : 2 * WIDE], part.n)
        share = np.zeros((part.n, WIDE))
        share[part.has] = by_word[part.has, WIDE:] / part.count[:, None]
        grads["word"], grads["char"] = _added(part.word_row, by_word[:, :WIDE], ROWS), _added(part.row, share[part.owner], ROWS)
        adam.step({k: (v + 1e-4 * p[k]).astype(np.float32) for k, v in grads.items()})
    x, _ = _top(logits(), doc, len(docs))
    return {
        "p": p, "platt": _fit_logistic(x, y.astype(float)),
        "word_odds": lower_bound(counts["word"][1], counts["word"][0], toxic, clean), "gram_odds": lower_bound(counts["gram"][1], counts["gram"][0], toxic, clean),
    }


class Scorer:
    """Texts to probabilities, with words' input rows remembered up to `most` words."""

    def __init__(self, model: dict, most: int = 150_000) -> None:
        self.m, self.most, self.known = model, most, None

    def _learn(self, words: list[bytes]) -> None:
        if self.known is None or len(self.known) + len(words) > self.most:
            self.known, self.rows = {b"": 0}, np.zeros((0, 6 * HIDDEN), np.float32)
            words = [b"", *(w for w in words if w)]
        p, w = self.m["p"], Words(words)
        feats = w.inputs(p, self.m["word_odds"][w.word_cell], w.best(self.m["gram_odds"].__getitem__))
        new = np.concatenate([feats @ p["wf"].T + p["bf"], feats @ p["wb"].T + p["bb"]], axis=1)
        if not len(self.rows):
            new[0] = 0
        self.known |= {x: i for i, x in enumerate(words, len(self.rows))}
        self.rows = np.concatenate([self.rows, new])

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities and the word at which each document's highest window starts."""
        docs = [words_of(t) for t in texts]
        distinct = {w for d in docs for w in d}
        new = [w for w in distinct if self.known is None or w not in self.known]
        if self.known is None or len(self.known) + len(new) > self.most:
            self.known, new = None, list(distinct)
        if new or self.known is None:
            self._learn(new)
        sizes = [len(d) for d in docs]
        ids = np.fromiter((self.known[w] for d in docs for w in d), np.int64, sum(sizes))
        ends = np.cumsum(sizes)
        starts = [window_starts(n) for n in sizes]
        owner = np.repeat(np.arange(len(docs)), [len(s) for s in starts])
        own = np.concatenate(starts)
        begin, end = own + (ends - sizes)[owner], ends[owner]
        out, h = [], 3 * HIDDEN
        for lo in range(0, len(own), 4096):
            g = _gather(begin[lo : lo + 4096], end[lo : lo + 4096], ids)
            x = np.ascontiguousarray(self.rows[g].transpose(0, 2, 1))
            out.append(_forward(self.m["p"], {"f": x[:, :h], "b": x[:, h:]}, g > 0)[0])
        feats, best = _top(np.concatenate(out), owner, len(docs))
        z = feats @ self.m["platt"][:-1] + self.m["platt"][-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), own[best]


def score_texts(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model.value)
        for batch in batches:
            q, at = [], []
            text, size, lo = batch.column("text").to_pylist(), 0, 0
            for i, t in enumerate(text):
                size += len(t or "")
                if size > 1 << 20 or i + 1 == len(text):
                    a, b = score(text[lo : i + 1])
                    q.append(a), at.append(b)
                    size, lo = 0, i + 1
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.concatenate(q)), pa.array(np.concatenate(at).astype(np.int64))], names=[*keep, "score", "worst_word"])

    return run


def _drawn(text: DataFrame, y: DataFrame) -> pd.DataFrame:
    """SAMPLE rows (doc_id, text, toxic) of each label at most, equal ones once, in a fixed order."""
    # twice the rows wanted, as some have no text; few enough to be sent to the texts
    parts = [text.join(F.broadcast(sample_by(y.where(F.col("toxic") == k), "toxic", 2 * n).limit(3 * n)), "doc_id").orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id", "text").limit(n) for k, n in SAMPLE.items()]
    return parts[0].unionByName(parts[1]).toPandas().drop_duplicates().sort_values(["doc_id", "text"])


def learn(docs: DataFrame, labels: DataFrame) -> dict | None:
    """A model from a bounded sample of the learning fold; None unless documents of both labels have texts."""
    y = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = docs.where(F.length("text") > 0)
    start = F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.greatest(F.lit(1), F.length("text") - LONGEST + 1)) + 1
    text = some.select("doc_id", F.col("text").substr(start.cast("int"), F.lit(LONGEST)).alias("text"))
    found = _drawn(text, y)
    if found["toxic"].nunique() < 2:  # a label's drawn rows are all without text: draw from those that have one
        found = _drawn(text, y.join(some.select("doc_id"), "doc_id", "left_semi"))
    if found["toxic"].nunique() < 2:
        return None
    return train(found["text"].tolist(), found["toxic"].tolist())


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted, worst_word.

    score is the probability that the text is toxic; predicted is 1 from THRESHOLD on; worst_word is where
    the highest window starts, in words from 0. Null and empty texts are one empty window. A null id
    belongs to the learning fold, but is never learned from. A document with several labels counts as toxic
    if one says so. Without learnable labels every score is 0. Repeated rows stay repeated.
    """
    model = learn(docs, labels)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    if model is None:
        scored = out.drop("text").withColumns({"score": F.lit(0.0), "worst_word": F.lit(0).cast("long")})
    else:
        schema = out.drop("text").withColumns({"score": F.lit(0.0), "worst_word": F.lit(0).cast("long")}).schema
        scored = out.mapInArrow(score_texts(docs.sparkSession.sparkContext.broadcast(model)), schema)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst_word")
