"""Quality by co-training two views: what a text says, and what is known about its page.

The content view is hashed character trigrams (square roots of frequencies) and shares of character kinds;
the metadata view is source, language, length and line layout. Each view has a logistic regression. In
each round, each view labels the documents of the pool it is most sure of, and these pseudo-labels train the
*other* view. Both are then calibrated (Platt) on labelled rows they never saw, and a last regression
over the two calibrated log odds combines them to score every whole document.

Nothing is learned from the held-out fold. The labelled sample is bounded: at most `LABELLED` rows of each
label. The pool is every other document of the learning fold that has an id and a text, whatever its number:
in each round executors score all of it, equal documents count once, and the surest are found from counts of
rounded log odds. Those at least as sure as `SUREST` are equally sure; ties go by a hash of the document.
Feature vectors reach the driver only of the sample and of the documents chosen. Without a pool (all of the
learning fold is in the sample) nothing is exchanged.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrid.llm.common import discard, held_out, stored, tidy
from talkgrid.llm.language_id import sample_by

LABELLED, ROUNDS, SURE, SUREST = 700, 4, 0.95, 6.0
#: Documents taken as good and as bad in the first round; round r takes r times as many.
GOOD, BAD = 60, 20
#: Log odds are rounded to so many steps a unit.
FINE = 10
CELLS, KINDS, META = 2048, 10, 96 + 32 + 12
REJECT_BELOW = 0.5

_KIND = np.zeros((6, 256), np.float32)  # upper, lower, digit, space, non-ASCII, other
for _c in range(256):
    _KIND[0 if 65 <= _c <= 90 else 1 if 97 <= _c <= 122 else 2 if 48 <= _c <= 57 else 3 if _c in b" \t\n\r\x0b\x0c" else 4 if _c >= 128 else 5, _c] = 1


def content(raw: bytes) -> np.ndarray:
    """The content view of a text: CELLS trigram cells, KINDS shares."""
    out = np.zeros(CELLS + KINDS, np.float32)
    if not raw:
        return out
    b = np.frombuffer(raw, np.uint8)
    if len(b) >= 3:
        x = b.astype(np.uint32)
        h = (x[:-2] * np.uint32(0x01000193) ^ x[1:-1] * np.uint32(0x0001F35D) ^ x[2:] * np.uint32(0x9E3779B1)) * np.uint32(0x85EBCA6B)
        seen = np.bincount(h >> np.uint32(21), minlength=CELLS)
        out[:CELLS] = np.sqrt(seen / len(h))
        out[-1] = np.count_nonzero(seen) / min(len(h), CELLS)
    count = np.bincount(b, minlength=256)
    out[CELLS : CELLS + 6] = _KIND @ (count / len(b))
    words = raw.split()
    out[CELLS + 6] = len(set(words)) / max(1, len(words))
    out[CELLS + 7] = min(4.0, len(b) / max(1, len(words)) / 10)
    out[CELLS + 8] = count[count > 0].max() / len(b)
    return out


def metadata(source: str | None, lang: str | None, raw: bytes) -> np.ndarray:
    """The page-metadata view: hashed source and language, length and line layout."""
    out = np.zeros(META, np.float32)
    out[zlib.crc32((source or "").encode("utf-8", "surrogatepass")) % 96] = 1
    out[96 + zlib.crc32((lang or "").encode("utf-8", "surrogatepass")) % 32] = 1
    lines = raw.split(b"\n")
    size = np.array([len(x) for x in lines])
    out[128] = np.log1p(len(raw)) / 10
    out[129] = np.log1p(len(lines)) / 5
    out[130] = np.log1p(size.mean()) / 8
    out[131] = np.log1p(size.max()) / 10
    out[132] = len(set(lines)) / len(lines)
    out[133] = (size < 40).mean()
    out[134 + min(5, int(np.log1p(len(raw)) / 2))] = 1
    return out


class Logistic:
    """Ridge logistic regression by gradient steps with momentum, on scaled inputs."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 200) -> None:
        self.mid, self.wide = x.mean(axis=0), x.std(axis=0) + 1e-2
        z = ((x - self.mid) / self.wide).astype(np.float32)
        w, b, mw, mb = np.zeros(x.shape[1], np.float32), np.float32(0), np.zeros(x.shape[1], np.float32), np.float32(0)
        weight = (weight / weight.sum()).astype(np.float32)
        rate = np.float32(1.0 / (0.25 * float((weight[:, None] * z * z).sum()) / 8 + ridge + 0.25))
        for _ in range(steps):
            e = (1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30))) - y) * weight
            mw = 0.9 * mw + z.T @ e + np.float32(ridge) * w
            mb = 0.9 * mb + e.sum()
            w = w - rate * mw * np.float32(0.3)
            b = b - np.float32(0.3) * mb
        self.w = (w / self.wide).astype(np.float32)
        self.b = float(b - self.mid @ self.w)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.b


def newton(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a small logistic regression, the bias last."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge * len(x) * np.eye(len(w)), x.T @ (y - q) - ridge * len(x) * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-7:
            break
    return w


def steps_of(model: Logistic, platt: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Log odds of one view in whole steps, from -SUREST to SUREST."""
    return np.rint(np.clip(model(x) * platt[0] + platt[1], -SUREST, SUREST) * FINE).astype(np.int32)


LEAST_SURE = int(np.ceil(np.log(SURE / (1 - SURE)) * FINE))


def surest(keys: np.ndarray, steps: np.ndarray, most: int, sign: int) -> np.ndarray:
    """Where the `most` documents are that one view is surest of, good (sign 1) or bad (-1)."""
    order = np.lexsort((keys, -sign * steps))[:most]
    return order[sign * steps[order] >= LEAST_SURE]


#: From (models, their calibrations, number of good, number of bad) to, for each view, what it is sure of:
#: the documents' keys, their labels and their matrices in both views.
Choose = Callable[[list, list, int, int], list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]]


def choose_from(keys: np.ndarray, pool: list[np.ndarray]) -> Choose:
    """A choice from a pool in memory."""

    def choose(models: list, platts: list, good: int, bad: int) -> list:
        out = []
        for v in (0, 1):
            steps = steps_of(models[v], platts[v], pool[v]) if len(keys) else np.zeros(0, np.int32)
            up, down = surest(keys, steps, good, 1), surest(keys, steps, bad, -1)
            both = np.concatenate([up, down])
            out.append((keys[both], np.repeat([1, 0], [len(up), len(down)]), [p[both] for p in pool]))
        return out

    return choose


def co_train(views: list[np.ndarray], y: np.ndarray, choose: Choose, prior: float, rounds: int = ROUNDS, seed: int = 9) -> dict:
    """Models of both views, their calibration and their combination. `views` holds a matrix for each view;
    `choose` gives the pseudo-labels; `prior` is the share of good documents, to which the sample is weighted
    back."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cut = np.zeros(len(y), bool)
    cut[order[: len(y) // 3]] = True  # calibration rows
    weight = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum()))
    ridge = (0.02, 0.02)
    extra: list[dict[int, tuple[int, np.ndarray]]] = [{}, {}]
    for r in range(rounds + 1):
        models = []
        for v in (0, 1):
            taught = [extra[v][k] for k in sorted(extra[v])]
            x = np.concatenate([views[v][~cut], *(row[None] for _, row in taught)])
            t = np.concatenate([y[~cut], [label for label, _ in taught]])
            w = np.concatenate([weight[~cut], np.full(len(taught), 0.3 * weight[~cut].sum() / max(1, len(taught)))])
            models.append(Logistic(x, t, w, ridge[v]))
        if r == rounds:
            break
        platts = [newton(models[v](views[v][~cut])[:, None], y[~cut]) for v in (0, 1)]
        found = choose(models, platts, GOOD * (r + 1), BAD * (r + 1))
        if not any(len(keys) for keys, _, _ in found):
            break
        for v, (keys, label, rows) in enumerate(found):
            extra[1 - v].update({int(k): (int(t), row) for k, t, row in zip(keys, label, rows[1 - v], strict=True)})
    platts = [newton(models[v](views[v][cut])[:, None], y[cut]) for v in (0, 1)]
    z = np.stack([models[v](views[v]) * platts[v][0] + platts[v][1] for v in (0, 1)], axis=1)
    shift = np.log(prior / (1 - prior)) - np.log(max(1, (y == 1).sum()) / max(1, (y == 0).sum()))
    top = newton(np.clip(z[cut], -12, 12), y[cut])
    top[-1] += shift
    return {"models": models, "platts": platts, "top": top, "pseudo": [len(e) for e in extra]}


def combined(model: dict, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of good quality: combined, by content, by metadata."""
    z = np.stack([np.clip(model["models"][v](views[v]) * model["platts"][v][0] + model["platts"][v][1], -12, 12) for v in (0, 1)], axis=1)
    prob = lambda t: 1 / (1 + np.exp(-np.clip(t, -30, 30)))
    return prob(z @ model["top"][:2] + model["top"][2]), prob(z[:, 0]), prob(z[:, 1])


def _views(batch: pa.RecordBatch) -> list[np.ndarray]:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
    source, lang = batch.column("source").to_pylist(), batch.column("lang").to_pylist()
    return [np.stack([content(x) for x in raw]), np.stack([metadata(*r) for r in zip(source, lang, raw, strict=True)])]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = _views(batch)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("quality"), *(pa.array([x.tobytes() for x in m], pa.binary()) for m in (a, b))], names=["key", "quality", "a", "b"])


def _matrices(rows: DataFrame) -> tuple[pa.Table, list[np.ndarray]]:
    """Rows (key, quality, text, lang, source), few, on the driver: by key, and as a matrix for each view."""
    found = rows.select("key", "quality", "text", "lang", "source").mapInArrow(_vectors, "key long, quality int, a binary, b binary").toArrow().sort_by([("key", "ascending"), ("a", "ascending"), ("b", "ascending")])
    wide = CELLS + KINDS, META
    return found, [np.frombuffer(b"".join(found.column(c).to_pylist()), np.float32).reshape(-1, n) for c, n in zip("ab", wide, strict=True)]


def _sure(models):
    """Rows (key, text, lang, source) to (key, s0, s1), the views' steps, where one of them is sure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                steps = [steps_of(m, p, x) for m, p, x in zip(*models.value, _views(part), strict=True)]
                mask = pa.array((np.abs(steps[0]) >= LEAST_SURE) | (np.abs(steps[1]) >= LEAST_SURE))
                yield pa.RecordBatch.from_arrays([x.filter(mask) for x in (part.column("key"), *map(pa.array, steps))], names=["key", "s0", "s1"])

    return run


def choose_in(pool: DataFrame) -> Choose:
    """A choice from all rows of `pool` (key, text, lang, source); rows of one key are one document."""

    def choose(models: list, platts: list, good: int, bad: int) -> list:
        spark = pool.sparkSession
        sent = spark.sparkContext.broadcast((models, platts))
        sure = stored(pool.mapInArrow(_sure(sent), "key long, s0 int, s1 int").distinct(), "sure")
        counts = sure.groupBy("s0", "s1").count().toPandas()  # bounded by the number of steps
        wanted = F.lit(False)
        for v in (0, 1):
            for sign, most in ((1, good), (-1, bad)):
                many = counts.groupby(sign * counts[f"s{v}"])["count"].sum().sort_index(ascending=False)
                many = many[many.index >= LEAST_SURE]
                before = many.cumsum() - many
                for step, n in many[before < most].items():
                    # of a step with more than are needed, those of the smallest hashes: four times as many, to be put in order
                    share = max(64, 4 * (most - before[step])) / n
                    near = F.col("key") <= int(share * 2**64) - 2**63 if share < 1 else F.lit(True)
                    wanted = wanted | ((F.col(f"s{v}") == int(sign * step)) & near)
        some = sure.where(wanted).toPandas().sort_values("key")
        discard(sure)
        keys = some["key"].to_numpy(np.int64)
        picks = []
        for v in (0, 1):
            steps = some[f"s{v}"].to_numpy(np.int32)
            up, down = surest(keys, steps, good, 1), surest(keys, steps, bad, -1)
            picks.append((keys[np.concatenate([up, down])], np.repeat([1, 0], [len(up), len(down)])))
        every = np.unique(np.concatenate([k for k, _ in picks]))
        if not len(every):
            return [(*p, [np.zeros((0, CELLS + KINDS), np.float32), np.zeros((0, META), np.float32)]) for p in picks]
        chosen = spark.createDataFrame([(int(k),) for k in every], "key long")
        texts = pool.join(F.broadcast(chosen), "key").groupBy("key").agg(F.min(F.struct("text", "lang", "source")).alias("r")).select("key", F.lit(None).cast("int").alias("quality"), "r.*")
        found, rows = _matrices(texts)
        at = [np.searchsorted(found.column("key").to_numpy(), k) for k, _ in picks]
        return [(k, t, [m[i] for m in rows]) for (k, t), i in zip(picks, at, strict=True)]

    return choose


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")])


def learn(docs: DataFrame, labels: DataFrame) -> dict | None:
    """A model from the labelled sample and the pool; None unless both labels occur in the sample."""
    y = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    rows = _texts(docs)
    counts = dict(y.groupBy("quality").count().collect())
    if len(counts) < 2:
        return None
    with tidy():
        # the few chosen ids are sent to the texts
        chosen = F.broadcast(stored(sample_by(y, "quality", LABELLED).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(3 * LABELLED), "labelled"))
        sample = rows.join(chosen, "doc_id").withColumnRenamed("doc_id", "key").distinct().orderBy(F.xxhash64("key"), "key", F.xxhash64("text", "lang", "source")).limit(4 * LABELLED)
        found, views = _matrices(sample)
        quality = found.column("quality").to_numpy().astype(float)
        if len(set(quality)) < 2:
            return None
        marked = [F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in ("lang", "source")]
        pool = rows.where("doc_id IS NOT NULL AND length(text) > 0").where(~held_out()).join(chosen, "doc_id", "left_anti")
        return co_train(views, quality, choose_in(pool.select(F.xxhash64("text", *marked).alias("key"), "text", "lang", "source")), counts[1] / (counts[0] + counts[1]))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [[], [], []]
            for at in range(0, batch.num_rows, 500):
                for own, q in zip(scores, combined(model.value, _views(batch.slice(at, 500))), strict=True):
                    own.append(q)
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(np.concatenate(q or [[]]).astype(np.float64)) for q in scores)], names=[*keep, "score", "content_score", "metadata_score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, reject_below: float = REJECT_BELOW) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang, source): doc_id, score, content_score, metadata_score, kept.

    score is the probability that the document is of good quality; it is kept from `reject_below` on. Null
    and empty texts are scored as empty and never kept. Null languages and sources are values of their own.
    A document with several labels takes the lowest. Without learnable labels every score is 1. Repeated
    rows stay repeated; other columns are ignored; an empty table gives no rows.
    """
    model = learn(docs, labels)
    rows = _texts(docs)
    if model is None:
        one = F.lit(1.0)
        scored = rows.withColumns({"score": one, "content_score": one, "metadata_score": one})
    else:
        scored = rows.withColumn("_some", F.coalesce(F.length("text"), F.lit(0)) > 0)
        schema = "doc_id long, lang string, source string, _some boolean, score double, content_score double, metadata_score double"
        scored = scored.mapInArrow(_score(rows.sparkSession.sparkContext.broadcast(model)), schema)
    some = F.col("_some") if model is not None else F.coalesce(F.length("text"), F.lit(0)) > 0
    return scored.select("doc_id", "score", "content_score", "metadata_score", ((F.col("score") >= reject_below) & some).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, reject_below: float = REJECT_BELOW) -> DataFrame:
    """The rows of `docs`, whole, that quality_scores keeps."""
    model = learn(docs, labels)
    some = docs.where(F.length(F.col("text").cast("string")) > 0)
    if model is None:
        return some
    model = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series, lang: pd.Series, source: pd.Series) -> pd.Series:
        batch = pa.RecordBatch.from_arrays([pa.array(x, pa.string(), from_pandas=True) for x in (text, lang, source)], names=["text", "lang", "source"])
        parts = [combined(model.value, _views(batch.slice(at, 500)))[0] for at in range(0, batch.num_rows, 500)]
        return pd.Series(np.concatenate(parts or [np.zeros(0)]).astype(np.float64))

    return some.where(score(*[F.col(c).cast("string") for c in ("text", "lang", "source")]) >= reject_below)
