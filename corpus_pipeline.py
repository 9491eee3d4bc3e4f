"""A corpus pipeline: five of the training-data operators, one after another, over the table `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talkgrid.llm import stages

STAGES = stages.STAGES

#: The trained stages can't be said in SQL; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)
