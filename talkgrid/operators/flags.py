"""Flags on transcript segments: disagreement with captions, low confidence, known mishearings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgrid.functions.text import containment_of, let, normalize_text, token_containment, tokens_of

DIVERGENCE, LOW_CONFIDENCE, MISHEARD = "divergence", "low_confidence", "misheard_match"
#: What to look at first; reasons not listed come last.
PRIORITY = {MISHEARD: 0, DIVERGENCE: 1, LOW_CONFIDENCE: 2}
LAST = 9


@dataclass(frozen=True)
class Thresholds:
    divergence_max: float = 0.5
    word_p_min: float = 0.4
    low_word_min: int = 2
    seg_logprob_min: float = -0.8
    merge_gap: float = 2.0


def is_divergent(asr: Column, captions: Column, t: Thresholds = Thresholds()) -> Column:
    return token_containment(asr, captions) < t.divergence_max


def is_unsure(words: Column, avg_logprob: Column, t: Thresholds = Thresholds()) -> Column:
    low = F.size(F.filter(F.coalesce(words, F.array().cast(WORDS)), lambda w: w["p"] < t.word_p_min))
    return (avg_logprob < t.seg_logprob_min) | (low >= t.low_word_min)


WORDS = T.ArrayType(T.StructType([T.StructField("w", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("start", "end", "p"))]))


def misheard_index(glossary: DataFrame) -> DataFrame:
    """(pos, heard, canonical): lower-cased mishearings in order of first appearance, each with the canonical
    form that came last, as a dictionary built in that order has it."""
    each = glossary.select(F.posexplode("misheard").alias("_j", "heard"), "entry_idx", "canonical").withColumn("heard", F.lower("heard"))
    place = F.struct("entry_idx", "_j")
    found = each.groupBy("heard").agg(F.min(place).alias("_first"), F.max_by("canonical", place).alias("canonical"))
    return found.select(F.col("_first").alias("pos"), "heard", "canonical")


#: Entries of a dictionary that make one array literal.
CHUNK = 2000


def misheard_lookup(index: DataFrame, chunk: int = CHUNK) -> Callable[[Column], Column]:
    """A function of a normalised text: the canonical form of the first mishearing whose normalised form is part of
    it, else null. The dictionary, which people write, becomes array literals of `chunk` entries that are tried in
    order, row by row: no join, and the same answer at every size."""
    known = index.withColumn("norm", normalize_text(F.col("heard"))).orderBy("pos").select("norm", "canonical").collect()
    chunks = [F.array(*[F.struct(F.lit(r["norm"]).alias("norm"), F.lit(r["canonical"]).alias("canonical")) for r in known[i : i + chunk]]) for i in range(0, len(known), chunk)]
    if not chunks:
        return lambda norm: F.lit(None).cast("string")
    return lambda norm: F.coalesce(*[F.get(F.filter(c, lambda m: F.contains(norm, m["norm"])), F.lit(0))["canonical"] for c in chunks])


def find_misheard(df: DataFrame, text: str, index: DataFrame, out: str, chunk: int = CHUNK) -> DataFrame:
    """`df` with `out`, what misheard_lookup finds in the text (null counts as empty), which is normalised once."""
    return df.withColumn(out, let(normalize_text(F.coalesce(F.col(text), F.lit(""))), misheard_lookup(index, chunk)))


def flag_segments(segments: DataFrame, index: DataFrame | None, with_captions: bool, t: Thresholds = Thresholds(), keep_all: bool = False) -> DataFrame:
    """Segments with `reasons`, in a fixed order, and `suggestion`. Needs caption_text if with_captions. Rows
    without a reason go unless keep_all. Both texts are normalised once for a row: what is made of them is a lambda
    over the two, and rows without a reason go as empty arrays, as a filter would compute everything again."""
    rows = segments if with_captions else segments.withColumn("caption_text", F.lit(""))
    lookup = misheard_lookup(index) if index is not None else lambda norm: F.lit(None).cast("string")
    unsure = F.coalesce(is_unsure(F.col("words"), F.col("avg_logprob"), t), F.lit(False))
    norms = F.struct(*[F.coalesce(normalize_text(F.col(c)), F.lit("")).alias(n) for c, n in (("text", "own"), ("caption_text", "cap"))], (F.col("text").isNotNull() & F.col("caption_text").isNotNull()).alias("both"))

    def judged(n: Column) -> Column:
        share = containment_of(tokens_of(n["own"]), tokens_of(n["cap"]))
        divergent = n["both"] & (share < t.divergence_max) if with_captions else F.lit(False)
        suggestion = F.coalesce(lookup(n["own"]), lookup(n["cap"])) if with_captions else lookup(n["own"])
        return F.struct(divergent.alias("divergent"), suggestion.alias("suggestion"))

    def named(x: Column) -> Column:
        reasons = F.array_compact(F.array(F.when(x["divergent"], DIVERGENCE), F.when(unsure, LOW_CONFIDENCE), F.when(x["suggestion"].isNotNull(), MISHEARD)))
        return F.struct(x["suggestion"].alias("suggestion"), reasons.alias("reasons"))

    found = F.transform(F.transform(F.array(norms), judged), named)
    kept = found if keep_all else F.filter(found, lambda x: F.size(x["reasons"]) > 0)
    return rows.select("*", F.inline(kept))


def sweep(segments: DataFrame, index: DataFrame | None, with_captions: bool, settings: list[Thresholds]) -> DataFrame:
    """flag_segments under each of a few settings, numbered; one union, so scans are shared."""
    parts = [flag_segments(segments, index, with_captions, t).withColumn("setting", F.lit(i)) for i, t in enumerate(settings)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def priority(reasons: Column) -> Column:
    """The best priority among reasons, LAST without any."""
    of = F.transform(reasons, lambda r: F.coalesce(*[F.when(r == k, v) for k, v in PRIORITY.items()], F.lit(LAST)))
    return F.coalesce(F.array_min(of), F.lit(LAST))
