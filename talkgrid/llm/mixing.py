"""Mixing sources to target weights by temperature, in DataFrame functions only.

Each source's token share is raised to an exponent and normalised. The exponent is found by bisection on
a grid: the largest whose mixture has the target entropy, and not below the smallest that keeps every
source's repetition under the limit. A probe is a set of sums over the per-source table, and one job
evaluates a whole row of probes, so no list of sources reaches the driver.

A source's weight times the budget is its budget of tokens: whole passes over the source, and for the rest
a prefix of a permutation. Documents are dealt into blocks by a hash, blocks are ordered by a hash, and
blocks are taken whole until one exceeds the budget; only that block's documents are put in order. A source of
n tokens has about the square root of n blocks of as many tokens each: so no source is sorted as a whole, and
what one task orders, blocks or documents, grows with that root alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkgrid.llm.common import stored

GRID, PROBES, SEED = 4096, 16, "mix"


def n_tokens(text: Column) -> Column:
    """Runs of other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _last_true(lo: int, hi: int, test) -> int:
    """The largest k in lo..hi for which a test that is true up to some k holds, lo if none: a row of probes at
    a time. test(ks) gives a list of booleans."""
    while lo < hi:
        step = math.ceil((hi - lo) / PROBES)
        ks = list(range(lo + step, hi + 1, step))
        ok = test(ks)
        hi = min((k - 1 for k, t in zip(ks, ok, strict=True) if not t), default=hi)
        lo = max((k for k, t in zip(ks, ok, strict=True) if t), default=lo)
    return lo


def exponent(sources: DataFrame, budget: float, entropy: float, repeats: float) -> float:
    """The exponent for a table (source, tokens) with tokens > 0. `entropy` is a share of the largest possible."""
    n, total, least = sources.agg(F.count("*"), F.sum("tokens"), F.min("tokens")).first()
    if not n:
        return 1.0
    p = F.col("tokens") / F.lit(float(total))
    low = least / total

    def entropies(ks: list[int]) -> list[bool]:
        sums = sources.agg(*[x for k in ks for x in (F.sum(F.pow(p, F.lit(k / GRID))), F.sum(F.pow(p, F.lit(k / GRID)) * F.log(p)))]).first()
        return [math.log(sums[2 * i]) - k / GRID * sums[2 * i + 1] / sums[2 * i] >= entropy * math.log(n) - 1e-9 for i, k in enumerate(ks)]

    def too_often(ks: list[int]) -> list[bool]:
        sums = sources.agg(*[F.sum(F.pow(p, F.lit(k / GRID))) for k in ks]).first()
        return [budget / total * low ** (k / GRID - 1) / sums[i] > repeats + 1e-9 for i, k in enumerate(ks)]

    tempered = _last_true(0, GRID, entropies)
    if too_often([0])[0]:
        tempered = max(tempered, min(GRID, _last_true(0, GRID, too_often) + 1))
    return tempered / GRID


def mixture(docs: DataFrame, budget: float = 1.0, entropy: float = 0.97, repeats: float = 4.0, seed: str = SEED) -> DataFrame:
    """One row per chosen copy: doc_id, source, n_tokens, epoch, weight, block_rank, place.

    `budget` is in passes over the whole table. A source with weight w gets floor(w * budget * tokens)
    tokens: epoch 1, 2, ... for whole passes, then a permuted prefix that ends before the first document
    that would exceed the budget. (block_rank, place) is the order within a source's epoch. If even the
    plain shares repeat a source too often, plain shares are used. A null source is a source of its own.
    Documents without words, null texts included, weigh nothing and are in no copy. Repeated rows and
    clashing or null ids are separate documents; exact ties are interchangeable. Other columns are ignored;
    an empty table gives no rows.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_tokens(F.col("text").cast("string")).alias("n_tokens"))
    slim = stored(slim.where("n_tokens > 0"), "tokens")
    sources = stored(slim.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    alpha = exponent(sources, budget * total, entropy, repeats)
    power = F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(alpha))
    norm = sources.agg(F.sum(power)).first()[0] or 1.0
    plan = sources.withColumn("weight", power / F.lit(norm)).withColumn("_due", F.floor(F.col("weight") * F.lit(float(budget * total)) + F.lit(1e-6)))
    plan = plan.withColumn("_whole", F.floor(F.col("_due") / F.col("tokens"))).withColumn("_rest", F.col("_due") - F.col("_whole") * F.col("tokens"))
    plan = plan.withColumn("_blocks", F.ceil(F.sqrt(F.col("tokens").cast("double"))).cast("long"))
    own = F.col("l.source").eqNullSafe(F.col("r.source"))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    dealt = slim.alias("l").join(plan.alias("r"), own).select("l.*", "r.weight", "r._whole", "r._rest", "r._blocks").withColumn("place", key)
    dealt = dealt.withColumn("_block", F.conv(F.substring("place", 1, 8), 16, 10).cast("long") % F.col("_blocks"))
    # blocks of a source in hashed order
    sized = dealt.groupBy("source", "_block").agg(F.sum("n_tokens").alias("_size"), F.first("_rest").alias("_rest"))
    mark = F.md5(F.concat_ws("|", F.lit(seed), F.lit("block"), F.coalesce("source", F.lit("")), F.col("_block").cast("string")).cast("binary"))
    order = Window.partitionBy("source").orderBy(mark, "_block")
    blocks = sized.withColumn("block_rank", F.row_number().over(order)).withColumn("_before", F.coalesce(F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = blocks.withColumn("_left", F.col("_rest") - F.col("_before")).withColumn("_state", F.when(F.col("_left") >= F.col("_size"), "all").when(F.col("_left") > 0, "some").otherwise("none"))
    cell = own & (F.col("l._block") == F.col("r._block"))
    placed = dealt.alias("l").join(blocks.alias("r"), cell).select("l.doc_id", "l.source", "l.n_tokens", "l.weight", "l._whole", "l.place", "l._block", "r.block_rank", "r._left", "r._state")
    inside = Window.partitionBy("source", "_block").orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    border = placed.where("_state = 'some'").withColumn("_in", F.sum("n_tokens").over(inside) <= F.col("_left"))
    rest = placed.where("_state != 'some'").withColumn("_in", F.col("_state") == "all").unionByName(border)
    copies = rest.withColumn("_n", F.col("_whole") + F.col("_in").cast("int")).where("_n > 0")
    return copies.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n").cast("long")))).select("doc_id", "source", "n_tokens", "epoch", F.round("weight", 9).alias("weight"), F.col("block_rank").cast("long").alias("block_rank"), "place")
