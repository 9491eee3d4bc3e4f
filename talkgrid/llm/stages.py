"""The stages of the corpus pipeline: five of the operators, one after another, over the table `documents`.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. The first four return
the columns of documents; the last returns the copies that the mixture is made of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talkgrid.llm.common import bound_batches, discard, ship, stored, table
from talkgrid.llm.decontaminate import clean
from talkgrid.llm.language_id import keep_known
from talkgrid.llm.mixing import mixture
from talkgrid.llm.near_dedup import one_of_each
from talkgrid.llm.quality_classifier import keep_good

#: Bytes of rows that a stage hands Python at once. All stages run on the same executors, whose heap is as large
#: as it gets by the third, so workers have to do with less than where an operator runs alone (common.BATCH_BYTES).
BATCH_BYTES = 512 << 10


def _ready(spark: SparkSession) -> None:
    """Lower batches last for the session: what a stage returns runs only after it."""
    ship(spark)
    bound_batches(spark, BATCH_BYTES)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go, and with them null and empty texts. A null id is
    scored as any other. Repeated rows stay repeated."""
    _ready(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is made out go: null and empty texts, those without a letter, and those
    of a low score. Repeated rows and rows without an id are judged each by its text."""
    _ready(spark)
    return keep_known(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id, in one row. Groups are
    made of five-word shingles at a similarity of 0.8. Rows without an id stay; null and empty texts are in no
    group with another id."""
    _ready(spark)
    return one_of_each(docs, width=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, each row by its own text, with or without an id.
    Null and empty texts stay."""
    _ready(spark)
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies of documents that the temperature mixture takes, with their places. Null and empty texts
    weigh nothing and are in no copy; a null source is a source of its own."""
    _ready(spark)
    return mixture(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order. What a stage kept is stored, and deleted when the next one is done with it."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
