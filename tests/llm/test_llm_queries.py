"""Registered queries against DuckDB, and the pipeline stage by stage against brute force."""

import sys
from pathlib import Path

import duckdb
import pytest
from helpers import leaks, near
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

from talkgrid.llm import queries, stages  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda df: sorted(tuple(r) for r in df[columns].astype(str).itertuples(index=False))
    assert key(got) == key(want)


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    benchmark = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        before = [(r.doc_id, r.text) for r in docs.collect()]
        if i < 4:
            assert out.columns == columns
            out = spark.createDataFrame(out.collect(), docs.schema)
            after = {r.doc_id for r in out.collect()}
            if i == 0:
                assert len(good & after) >= 0.97 * len(good) and len(after) < len(before)
            elif i == 1:
                assert len(after) >= 0.99 * len(before)
            elif i == 2:
                assert after == {d for d, _, _, kept in near(before, 5, 80) if kept}
            else:
                assert after == {r[0] for r in leaks(before, benchmark) if not r[5]}
            docs = out
        else:
            assert out.select("doc_id").distinct().join(docs, "doc_id", "left_anti").count() == 0 and out.count() > 0


def test_pipeline_stages_take_odd_rows(spark):
    rows = [(None, "some words that are long enough to keep", "en", "s", 1), (7, None, None, None, None), (8, "", "en", "s", 0), (9, "words in a row " * 9, "en", None, 3), (9, "words in a row " * 9, "en", None, 3)]
    base = spark.read.parquet(f"{SF}/documents.parquet")
    docs = base.withColumn("doc_id", F.col("doc_id") + 100).unionByName(spark.createDataFrame(rows, base.schema))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() > 0
        stage(spark, docs.limit(0), SF).count()


def test_decontamination_judges_each_row_by_its_text(spark, tmp_path):
    leak = "one two three four five six seven eight nine ten eleven"
    docs = [(None, f"before {leak} after"), (None, "clean text"), (None, None), (1, leak), (1, "clean text that shares an id"), (2, "clean")]
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = stages.benchmark_decontamination(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert kept.columns == ["doc_id", "text"]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, (d for d in docs if leak not in (d[1] or ""))))


def test_stages_hand_python_little_at_once(spark):
    key, limit = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    long = spark.range(400, numPartitions=1).select(F.repeat(F.lit("word "), 2000).alias("text"))
    before = spark.conf.get(key)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(key, str(16 << 20))
            stage(spark, docs, SF)
            got = [r.n for r in long.mapInArrow(sizes, "n long").collect()]
            assert max(got) <= limit and sum(got) >= 4_000_000
    finally:
        spark.conf.set(key, before)
