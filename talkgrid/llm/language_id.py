"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded, documented sample: at most
`SAMPLE` rows of each language, one passage of at most `PASSAGE` characters of each, from the learning
fold only, and `MOST_ROWS` rows (200 MB of text) in all. It labels every byte position; a document's probabilities are the mean over its letters.
Whole texts are scored, cut into stretches of `STRETCH` bytes that see `MARGIN` bytes on either side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrid.llm.bigru import Adam, Params, scan, scan_back, softmax
from talkgrid.llm.common import held_out, in_slices, text_bytes

HIDDEN, STRETCH, MARGIN, SAMPLE, PASSAGE = 8, 192, 16, 400, 2000
MOST_ROWS = 100_000
STEPS, BATCH, LENGTH = 260, 192, 64

_LETTER = np.array([65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def train(texts: list[str], labels: list[int], n_labels: int, seed: int = 5, steps: int = STEPS) -> Params:
    rng = np.random.default_rng(seed)
    data = [_FOLD[np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)] for t in texts]
    by = [[i for i, y in enumerate(labels) if y == k and len(data[i])] for k in range(n_labels)]
    by = [x for x in by if x]
    h = HIDDEN
    p: Params = {f"x{d}": rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32) for d in "fb"}
    p |= {f"u{d}": rng.normal(0, 0.3, (3 * h, h)).astype(np.float32) for d in "fb"}
    p |= {f"v{d}": rng.normal(0, 0.3, (n_labels, h)).astype(np.float32) for d in "fb"} | {"c": np.zeros(n_labels, np.float32)}
    adam = Adam(p, 0.02)
    for step in range(steps):
        adam.rate = 0.02 * (1 - 0.9 * step / steps)
        own = [by[k][rng.integers(len(by[k]))] for k in rng.integers(0, len(by), BATCH)]
        ids = np.zeros((LENGTH, BATCH), np.uint8)
        for j, i in enumerate(own):
            at = rng.integers(0, max(1, len(data[i]) - LENGTH + 1))
            piece = data[i][at : at + LENGTH]
            ids[: len(piece), j] = piece
        y = np.array([labels[i] for i in own])
        x = {d: np.ascontiguousarray(p[f"x{d}"][ids].transpose(0, 2, 1)) for d in "fb"}
        s = {d: scan(x[d], p[f"u{d}"], d == "b") for d in "fb"}
        q = softmax(p["vf"] @ s["f"] + p["vb"] @ s["b"] + p["c"][:, None], axis=1)
        q[:, y, np.arange(BATCH)] -= 1
        q *= _LETTER[ids][:, None, :] / max(1, int(_LETTER[ids].sum()))
        g: Params = {"c": q.sum(axis=(0, 2))}
        for d in "fb":
            g[f"v{d}"] = np.einsum("tkb,thb->kh", q, s[d])
            dx, g[f"u{d}"] = scan_back(x[d], p[f"u{d}"], s[d], np.matmul(p[f"v{d}"].T, q), d == "b")
            g[f"x{d}"] = np.zeros_like(p[f"x{d}"])
            np.add.at(g[f"x{d}"], ids.ravel(), dx.transpose(0, 2, 1).reshape(-1, 3 * h))
        adam.step({k: v.astype(np.float32) for k, v in g.items()})
    return p


class Labeller:
    """Pools the network's position labels: texts to (n, languages) probabilities, and letters counted."""

    def __init__(self, p: Params) -> None:
        self.p = p
        fold = p["xf"][_FOLD], p["xb"][_FOLD]
        self.tables = [np.ascontiguousarray(t.T) for t in fold]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(offsets) - 1, len(self.p["c"])
        total, letters = np.zeros((n, k)), np.zeros(n)
        size = np.diff(offsets)
        count = -(-size // STRETCH)
        doc = np.repeat(np.arange(n), count)
        at = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * STRETCH + offsets[doc]
        for lo in range(0, len(doc), 4096):
            d, a = doc[lo : lo + 4096], at[lo : lo + 4096]
            place = a[None, :] + np.arange(-MARGIN, STRETCH + MARGIN)[:, None]
            inside = (place >= offsets[d]) & (place < offsets[d + 1])
            ids = np.where(inside, data[np.clip(place, 0, len(data) - 1)], 0).astype(np.uint8)
            pooled, seen = self._positions(ids)
            np.add.at(total, d, pooled)
            np.add.at(letters, d, seen)
        return total / np.maximum(letters, 1)[:, None], letters

    def _positions(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, steps, batch = self.p, *ids.shape
        backward = _run(self.tables[1], p["ub"], p["vb"], ids, True, None)
        return _run(self.tables[0], p["uf"], p["vf"], ids, False, backward + p["c"][:, None])


def _run(table, u, v, ids, reverse, other):
    """One direction over all steps without keeping states. Backward: its share of each position's logits.
    Forward: adds that share, and sums the probabilities of letters in the stretch."""
    steps, batch = ids.shape
    wide, h = table.shape[0], u.shape[1]
    state, a, x = np.zeros((h, batch), np.float32), np.empty((wide, batch), np.float32), np.empty((wide, batch), np.float32)
    half = np.float32(0.5)
    logits = np.empty((steps, len(v), batch), np.float32) if reverse else None
    pooled, seen = np.zeros((len(v), batch), np.float32), np.zeros(batch, np.float32)
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        np.take(table, ids[t], axis=1, out=x, mode="clip")
        np.matmul(u, state, out=a)
        g = x[: 2 * h]
        g += a[: 2 * h]
        g *= half
        np.tanh(g, out=g)
        g += np.float32(1)
        g *= half
        c = a[2 * h :]
        c *= g[h:]
        c += x[2 * h :]
        np.tanh(c, out=c)
        state -= c
        state *= g[:h]
        state += c
        if reverse:
            np.matmul(v, state, out=logits[t])
        elif MARGIN <= t < steps - MARGIN:
            y = v @ state
            y += other[t]
            y -= y.max(axis=0)
            np.exp(y, out=y)
            live = _LETTER[ids[t]].astype(np.float32)
            y *= live / y.sum(axis=0)
            pooled += y
            seen += live
    return logits if reverse else (pooled.T.astype(np.float64), seen.astype(np.float64))


def label_texts(model, langs: list[str]):
    """Arrow batches (doc_id, held_out, text) to (doc_id, held_out, lang_pred, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, names = Labeller(model.value), np.array([*langs, "und"], dtype=object)
        for batch in batches:
            text = batch.column("text")
            data, offsets = text_bytes(text)
            best, score = np.full(batch.num_rows, len(langs)), np.zeros(batch.num_rows)
            for i, j in in_slices(offsets, 1 << 21):
                q, letters = label(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                some = letters > 0
                for r in np.flatnonzero(some & ~_ascii_letter(data, offsets, i, j)):
                    some[r] = any(c.isalpha() for c in text[int(i + r)].as_py())
                best[i:j] = np.where(some, q.argmax(axis=1), len(langs))
                score[i:j] = np.where(some, q.max(axis=1), 0.0)
            keep = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1))], names=[*(c for c in batch.schema.names if c != "text"), "lang_pred", "score"])

    return run


def _ascii_letter(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> np.ndarray:
    part = data[offsets[i] : offsets[j]] | 32
    total = np.concatenate([[0], np.cumsum((part >= 97) & (part <= 122))])
    at = offsets[i : j + 1] - offsets[i]
    return total[at[1:]] > total[at[:-1]]


def sample_by(df: DataFrame, label: str, rows: int, seed: int = 11) -> DataFrame:
    """About `rows` rows of each label at most, the smallest by a hash of the id, whatever the partitioning."""
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    share = F.least(F.lit(1.0), F.lit(float(rows)) / F.col("_n"))
    cell = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return df.join(F.broadcast(n.orderBy(F.desc("_n"), label).limit(1000)), label).where(cell < share).drop("_n")


def learn(docs: DataFrame, rows: int = SAMPLE, seed: int = 5) -> tuple[Params, list[str]]:
    """A network from the learning fold's rows with an id, a language and a text. The 1,000 commonest language
    values are learned, from about `rows` rows each, MOST_ROWS in all. Rows that share an id are one draw: equal
    ones count once, and all in all no more than twice the rows wanted are taken."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    n_langs = min(1000, known.select("lang").distinct().count())
    rows = max(1, min(rows, MOST_ROWS // max(1, n_langs)))
    start = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.greatest(F.lit(1), F.length("text") - PASSAGE)) + 1
    found = sample_by(known.select("doc_id", "text", "lang"), "lang", rows).select("doc_id", "lang", F.col("text").substr(start.cast("int"), F.lit(PASSAGE)).alias("text")).distinct().orderBy(F.xxhash64("doc_id", "lang", "text")).limit(2 * rows * max(1, n_langs)).toPandas()
    found = found.sort_values(["doc_id", "lang", "text"], na_position="first")
    langs = sorted(found["lang"].unique())
    number = {x: i for i, x in enumerate(langs)}
    if not langs:
        return {}, []
    return train(found["text"].tolist(), [number[x] for x in found["lang"]], len(langs), seed), langs


def identify(docs: DataFrame, rows: int = SAMPLE, keep: list[str] | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, lang_pred, score (and the columns in `keep`).

    lang_pred is a language of the learning fold, `und` (score 0) where the text is null or has no letter,
    or where nothing could be learned. Ties go to the first language by name. Repeated rows stay repeated;
    a null id belongs to the learning fold. lang, source and doc_id are no inputs of a prediction.
    """
    model, langs = learn(docs, rows)
    extra = keep or []
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), *extra, F.col("text").cast("string").alias("text"))
    if not langs:
        return out.drop("text").withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    schema = out.drop("text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return out.mapInArrow(label_texts(docs.sparkSession.sparkContext.broadcast(model), langs), schema)


def keep_known(docs: DataFrame, rows: int = SAMPLE, least: float = 0.4) -> DataFrame:
    """The rows of `docs`, whole, in which a language is made out: not `und`, and with a score of `least` or
    more. Without learnable languages every row with a letter stays."""
    model, langs = learn(docs, rows)
    if not langs:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    run = label_texts(docs.sparkSession.sparkContext.broadcast(model), langs)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        batch = pa.RecordBatch.from_arrays([pa.array(text, pa.string(), from_pandas=True)], names=["text"])
        return next(run(iter([batch]))).column("score").to_pandas() if len(text) else pd.Series([], dtype=float)

    return docs.where(score(F.col("text").cast("string")) >= least)
