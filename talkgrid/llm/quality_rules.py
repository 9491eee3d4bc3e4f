"""Quality rules: repetition and symbol counts, and n-gram perplexity bands by language.

The perplexity model is a modified Kneser-Ney model over UTF-8 bytes, one for each language value.
Spark counts every n-gram of every document (tasks merge their counts before the shuffle) and derives
the continuation counts of lower orders and the discounts. The model is kept as sorted hash arrays, in
shards of about `SHARD` top-order entries, dealt by language and the byte before the predicted one: all orders
that one prediction needs then lie in one shard. (One byte of one language is the smallest shard: byte 5-grams
of a language level off, as its words do, so that too is bounded by the language and not by the corpus.) A model of one shard, the usual case, is scored in one
pass; with more, each shard is a pass that scores its own positions. So what a task holds is bounded.

The corpus holds the document that is scored, so an n-gram seen once is that document's own: it is scored
as unseen, by backing off (and so on down the orders). Else odd text would vouch for itself.

A document is rejected if its log perplexity lies outside its language's band: the median, plus and minus
`SLACK`, `SPREADS` robust standard deviations, and an allowance for short texts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrid.llm.common import in_slices, stored, text_bytes

ORDER, SHARD = 5, 4_000_000
SLACK, SPREADS, SHORT = 0.25, 4.0, 6.0
_LOW = (1 << 40) - 1
_GAP = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text or "") - (len(raw) - len(raw.translate(None, _GAP)))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    again = 0
    for line in raw.split(b"\n"):
        if line.strip(_GAP):
            again += line in seen
            seen.add(line)
    return len(words), chars, symbols, again, _repeated(words)


def _repeated(words: list[bytes], wide: int = 5) -> int:
    """Words that lie in a window of `wide` words found twice or more."""
    n = len(words) - wide + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    code = ids
    for k in range(1, wide):  # exact: a window's number, from its first words' number and the next word
        code = code[:n + wide - 1 - k] * len(number) + ids[k:]
        if k < wide - 1 and len(number) ** (k + 2) > 2**62:
            code = np.unique(code, return_inverse=True)[1]
    _, back, count = np.unique(code, return_inverse=True, return_counts=True)
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(count[back] > 1)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + wide, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def lang_code(lang: str | None) -> int:
    """23 bits that stand for a language value in n-gram codes."""
    return zlib.crc32((lang or "").encode("utf-8", "surrogatepass")) & 0x7FFFFF


def ngram_codes(data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """For each byte: the language, the ORDER - 1 bytes before it in its text (0 before the start), and it."""
    out = np.repeat(langs.astype(np.int64) << 40, np.diff(offsets))
    out |= data
    first = offsets[:-1][np.diff(offsets) > 0]
    for k in range(1, ORDER):
        part = np.zeros(len(data), np.int64)
        part[k:] = data[:-k]
        for j in range(k):  # the first k bytes of a text have nothing k bytes before
            at = first + j
            part[at[at < len(data)]] = 0
        # a text shorter than k may have reached into the next one's first bytes: those are 0 anyway
        out |= part << (8 * k)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        codes, n = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], n[order]
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
        return codes[first], np.add.reduceat(n, first) if len(first) else n

    def batch_of(codes, n):
        return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])

    for batch in batches:
        langs = np.array([lang_code(x) for x in batch.column("lang").to_pylist()], np.int64)
        data, offsets = text_bytes(batch.column("text"))
        for i, j in in_slices(offsets, 1 << 22):
            codes = np.sort(ngram_codes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], langs[i:j]))
            if len(codes):
                first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
                held.append((codes[first], np.diff(np.r_[first, len(codes)])))
            if sum(len(h[0]) for h in held) > 3_000_000:
                held = [merged()]
                if len(held[0][0]) > 1_500_000:  # too many to hold: let the shuffle add them up
                    yield batch_of(*held.pop())
    if held:
        yield batch_of(*merged())


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class HashArray:
    """Codes' hashes, sorted, with a value each; a table of the hashes' leading bits says where to look."""

    def __init__(self, codes: np.ndarray, values: np.ndarray) -> None:
        keys = _mix(codes)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.uint64(2**64 - 1))
        self.values = np.append(values[order], 0).astype(np.float32)
        self.bits = max(1, int(len(codes)).bit_length())
        self.jump = np.searchsorted(self.keys[:-1], np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)

    def __call__(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none), and whether there is one."""
        keys = _mix(codes)
        at = self.jump[(keys >> np.uint64(64 - self.bits)).astype(np.int64)]
        there = self.keys[at]
        todo = np.flatnonzero(there < keys)
        while len(todo):
            at[todo] += 1
            there[todo] = self.keys[at[todo]]
            todo = todo[there[todo] < keys[todo]]
        known = (there == keys) & (at < len(self.keys) - 1)
        return np.where(known, self.values[at], np.float32(0)), known


def _context(codes: np.ndarray) -> np.ndarray:
    return (codes >> 40 << 40) | ((codes & _LOW) >> 8)


def _suffix(codes: np.ndarray, n: int) -> np.ndarray:
    return (codes >> 40 << 40) | (codes & ((1 << 8 * n) - 1))


def discounts(counts_of_counts: dict[tuple[int, int, int], int], order: int, lang: int) -> tuple[float, float, float]:
    """D1, D2 and D3+ of modified Kneser-Ney from n1 to n4; plain defaults where those are too few."""
    n = [counts_of_counts.get((order, lang, k), 0) for k in range(1, 5)]
    if not all(n):
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(k - 1e-3, max(1e-3, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3))


class Model:
    """A shard: log probabilities of the n-grams of every order, and back-off weights of their contexts.
    `own`: the texts to score are part of the counts."""

    def __init__(self, tables: dict[int, tuple[np.ndarray, np.ndarray]], counts_of_counts: dict, own: bool = True) -> None:
        self.levels: dict[int, HashArray] = {}
        self.weights: dict[int, HashArray] = {}
        codes_below, p_below, q_below = None, None, None
        for n in range(1, ORDER + 1):
            codes, c = tables[n]
            order = np.argsort(codes)
            codes, c = codes[order], c[order].astype(np.float64)
            lang, back = np.unique(codes >> 40, return_inverse=True)
            d = np.array([discounts(counts_of_counts, n, int(x)) for x in lang]).reshape(-1, 3)[back]
            cut = np.select([c == 1, c == 2], [d[:, 0], d[:, 1]], d[:, 2]) if len(codes) else c
            context = _context(codes)
            first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(codes) else np.zeros(0, np.int64)
            size = np.diff(np.r_[first, len(codes)])
            total = np.add.reduceat(c, first) if len(first) else c
            gamma = np.add.reduceat(cut, first) / total if len(first) else c
            p = (c - cut) / np.repeat(total, size)
            back = np.repeat(gamma, size)
            below = np.searchsorted(codes_below, _suffix(codes, n - 1)) if n > 1 else None
            p += back * p_below[below] if n > 1 else back / 257
            unseen = np.where(np.repeat(total, size) > 1, back, 1.0) * (q_below[below] if n > 1 else 1 / 257)
            q = np.where(c == 1, unseen, p)
            self.levels[n] = HashArray(codes, np.log(q if own and n == ORDER else p))
            self.weights[n] = HashArray(context[first], np.log(gamma))
            codes_below, p_below, q_below = codes, p, q

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """log p(last byte | bytes before), natural."""
        out, known = self.levels[ORDER](codes)
        at = np.flatnonzero(~known)
        for n in range(ORDER - 1, -1, -1):
            if not len(at):
                break
            out[at] += self.weights[n + 1](_context(_suffix(codes[at], n + 1)))[0]
            if n:
                value, known = self.levels[n](_suffix(codes[at], n))
                out[at[known]] += value[known]
                at = at[~known]
            else:
                out[at] -= np.float32(math.log(257))
        return out


class KneserNey:
    """The counts of a corpus as Spark tables, and their model shard by shard."""

    def __init__(self, docs: DataFrame, shard: int = SHARD) -> None:
        self.spark = docs.sparkSession
        top = docs.select("text", "lang").mapInArrow(_counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
        self.tables = {ORDER: stored(top, "ngrams")}
        for n in range(ORDER - 1, 0, -1):  # a lower order counts the distinct bytes seen before it
            low = F.col("code").bitwiseAND((1 << 8 * n) - 1).bitwiseOR(F.shiftleft(F.shiftright("code", 40), 40))
            self.tables[n] = stored(self.tables[n + 1].groupBy(low.alias("code")).agg(F.count("*").alias("n")), "ngrams")
        self.counts_of_counts = {}
        for n, t in self.tables.items():
            for lang, c, k in t.where("n < 5").groupBy(F.shiftright("code", 40).alias("lang"), "n").agg(F.count("*").alias("k")).collect():
                self.counts_of_counts[n, lang, c] = k
        self.entries = self.tables[ORDER].count()
        deals = self.tables[2].select(F.shiftright("code", 8)).distinct().count()
        self.shards = max(1, min(deals, math.ceil(self.entries / shard)))

    def part(self, s: int, own: bool = True) -> Model:
        tables = {}
        for n, t in self.tables.items():
            if self.shards > 1 and n > 1:
                t = t.where((F.shiftright("code", 40) * 257 + F.shiftright("code", 8).bitwiseAND(255)) % self.shards == s)
            got = t.toArrow()
            tables[n] = got.column("code").to_numpy(), got.column("n").to_numpy()
        return Model(tables, self.counts_of_counts, own)


def _scored(model, shards: int, s: int, rules: bool):
    """Texts to (doc_id, lang, doc_key, base counts if `rules`, log_p, n_bytes) for the positions of shard s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            codes_of = np.array([lang_code(x) for x in langs], np.int64)
            data, offsets = text_bytes(batch.column("text"))
            log_p = np.zeros(batch.num_rows)
            for i, j in in_slices(offsets, 1 << 20):
                at = offsets[i : j + 1] - offsets[i]
                codes = ngram_codes(data[offsets[i] : offsets[j]], at, codes_of[i:j])
                if shards > 1:
                    value = np.zeros(len(codes))
                    own = np.flatnonzero(((codes >> 40) * 257 + (codes >> 8 & 255)) % shards == s)
                    value[own] = model.value(codes[own])
                else:
                    value = model.value(codes)
                total = np.concatenate([[0], np.cumsum(value, dtype=np.float64)])
                log_p[i:j] = total[at[1:]] - total[at[:-1]]
            texts = batch.column("text").to_pylist()
            keys = [xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass")) - (1 << 63) for t in texts] if shards > 1 else [0] * len(texts)
            columns = [batch.column("doc_id"), batch.column("lang"), pa.array(keys, pa.int64())]
            names = ["doc_id", "lang", "doc_key"]
            if rules:
                columns += [pa.array(x, pa.int64()) for x in zip(*(base_counts(t) for t in texts), strict=True)]
                names += [x.split()[0] for x in BASE.split(", ")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(log_p), pa.array(np.diff(offsets), pa.int64())], names=[*names, "log_p", "n_bytes"])

    return run


def perplexities(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per row of `docs`: doc_id, lang, base counts, log_ppl (per byte; null for an empty text), n_bytes."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    model = KneserNey(texts, shard)
    sc, out = texts.sparkSession.sparkContext, None
    head = "doc_id long, lang string, doc_key long"
    for s in range(model.shards):
        part = texts.mapInArrow(_scored(sc.broadcast(model.part(s)), model.shards, s, not s), f"{head}, {BASE + ', ' if not s else ''}log_p double, n_bytes long")
        part = stored(part, "scores") if model.shards > 1 else part
        if out is None:
            out = part
            continue
        part = part.select("doc_id", "lang", "doc_key", F.col("log_p").alias("_more")).dropDuplicates(["doc_id", "lang", "doc_key"])
        same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & F.col("l.lang").eqNullSafe(F.col("r.lang")) & (F.col("l.doc_key") == F.col("r.doc_key"))
        out = out.alias("l").join(part.alias("r"), same, "left").select("l.*", F.col("r._more")).withColumn("log_p", F.col("log_p") + F.col("_more")).drop("_more")
    return out.withColumn("log_ppl", F.when(F.col("n_bytes") > 0, -F.col("log_p") / F.col("n_bytes"))).drop("doc_key", "log_p")


def quality(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, log_ppl, low, high.

    Null and empty texts have no words, so base_failed. A null language has a model and band of its own.
    Repeated rows stay repeated (and count as often in the model); an empty table gives no rows.
    """
    scored = stored(perplexities(docs, shard), "perplexities")
    quartiles = scored.where("log_ppl IS NOT NULL").groupBy("lang").agg(F.percentile_approx("log_ppl", [0.25, 0.5, 0.75], 10_000).alias("_q"))
    spread = (F.col("_q")[2] - F.col("_q")[0]) / 1.349
    bands = quartiles.select(F.col("lang").alias("_lang"), F.col("_q")[1].alias("_mid"), (F.lit(SLACK) + SPREADS * spread).alias("_wide"))
    joined = scored.join(bands, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    wide = F.col("_wide") + F.lit(SHORT) / F.sqrt(F.greatest(F.col("n_bytes"), F.lit(1)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = joined.withColumns({"base_failed": failed, "low": F.col("_mid") - wide, "high": F.col("_mid") + wide})
    verdict = ~F.col("base_failed") & F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(False))
    return out.select("doc_id", *[x.split()[0] for x in BASE.split(", ")], "base_failed", verdict.alias("kept"), "log_ppl", "low", "high")
