"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = 16 << 20
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="talkgrid-")) / "talkgrid.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(path))
        _shipped.add(sc.applicationId)
        bound_batches(spark, BATCH_BYTES)


def bound_batches(spark: SparkSession, most: int) -> None:
    """From now on, what this session hands Python at once is about `most` bytes, or one row: texts may be long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, str(min(most, int(spark.conf.get(key).rstrip("b")))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the context's checkpoint folder. Only where
    neither is set, and driver and executors are one process, a folder of this machine."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = tempfile.mkdtemp(prefix="talkgrid-")
    return _local[sc.applicationId]


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within this, what runs hands Python at most `rows` rows at a time: for rows that may be large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


_scopes: list[list[DataFrame]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    sc = df.sparkSession.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def tidy() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """At its end, what stored() wrote inside is deleted, but for what was passed to the function it gives."""
    held: list[DataFrame] = []
    result: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        result.append(df)
        return df

    _scopes.append(held)
    try:
        yield keep
    finally:
        _scopes.pop()
        for df in held:
            if not any(df is r for r in result):
                discard(df)
        if _scopes:
            _scopes[-1].extend(result)


#: Bits of a bitmap of keys: eight or more for each key, as far as the largest goes (16 MB).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27


def bitmap_of(keys: DataFrame) -> tuple[Broadcast, int]:
    """A broadcast bitmap of a column of hashed longs, and its number of bits, at most MOST_BITS whatever the
    number of keys: a bit that isn't set says that a key isn't among them."""
    keys = keys.toDF("k")
    bits = int(min(MOST_BITS, max(LEAST_BITS, 1 << (8 * keys.count()).bit_length())))
    bit = F.expr(f"shiftleft(1L, int(pmod(k, {bits}) % 64))")
    marks = keys.where("k IS NOT NULL").groupBy(F.shiftright(F.pmod("k", F.lit(bits)), 6).alias("w")).agg(F.bit_or(bit).alias("v")).toArrow()
    found = np.zeros(bits // 64, np.uint64)
    found[marks.column("w").to_numpy()] = marks.column("v").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(found), bits


def is_marked(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def without(df: DataFrame, gone: DataFrame, by: list[Column]) -> DataFrame:
    """The rows of df whose values of `by` are no row of `gone` (nulls equal nulls). Rows that a bitmap of `gone`
    rules out stay where they are: only the others, few more than those that go, are shuffled to meet it."""
    maybe, rest, names = _met(df, gone, by)
    on = F.lit(True)
    for n in names:
        on = on & F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}"))
    return rest.drop(*names).unionByName(maybe.alias("l").join(gone.toDF(*names).distinct().alias("r"), on, "left_anti").drop(*names))


def _met(df: DataFrame, keys: DataFrame, by: list[Column]) -> tuple[DataFrame, DataFrame, list[str]]:
    """df in two, with `by` as columns of the names returned: rows that may be in `keys`, and rows that aren't."""
    names = [f"_by{i}" for i in range(len(by))]
    bitmap, bits = bitmap_of(keys.toDF(*names).select(F.xxhash64(*names)))

    @F.pandas_udf("boolean")
    def marked(at: pd.Series) -> pd.Series:
        return pd.Series(is_marked(bitmap.value, at.to_numpy()))

    keyed = df.withColumns(dict(zip(names, by, strict=True)))
    flagged = keyed.withColumn("_marked", marked(F.pmod(F.xxhash64(*names), F.lit(bits))))
    return flagged.where("_marked").drop("_marked"), flagged.where("NOT _marked").drop("_marked"), names


def one_row_each(df: DataFrame, again: DataFrame, by: Column) -> DataFrame:
    """df with one row for each value of `by` that is in `again`: the first by a hash of the row, then as JSON."""
    maybe, rest, names = _met(df, again, [by])
    row = F.struct(*df.columns)
    some = maybe.join(again.toDF(*names).distinct(), names, "left_semi").groupBy(*names).agg(F.min_by(row, F.struct(F.xxhash64(*df.columns), F.to_json(row))).alias("r")).select("r.*")
    others = maybe.join(again.toDF(*names).distinct(), names, "left_anti").drop(*names)
    return rest.drop(*names).unionByName(others).unionByName(some)


def held_out(column: str = "doc_id") -> Column:
    """True for the fold that no model may learn from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fold(ids: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(str(int(i)).encode()) % 3 == 1 for i in ids], dtype=bool)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column, one after another, and the n + 1 offsets; nulls are empty."""
    column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), offsets - (offsets[0] if len(offsets) else 0)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def in_slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about `most` bytes each, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)
