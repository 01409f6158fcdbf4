"""Helpers that the training-data operators share: storage, batches, words."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: What separates words: space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
FALLBACK_DIR = "file:///tmp/checkpoints/tallyforge"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the cluster's ``spark.checkpoint.dir``.

    Where that is unset, a local session, whose executors are the driver itself,
    takes a folder under /tmp; any other raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = FALLBACK_DIR
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_made: list[str] = []


def fresh_path(spark: SparkSession, tag: str) -> str:
    _made.append(f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}")
    return _made[-1]


def _delete(spark: SparkSession, made: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(made)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def purge(spark: SparkSession) -> None:
    """Delete what this process has put into the shared folder, once its results are written elsewhere."""
    while _made:
        _delete(spark, _made.pop())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[set[str]]:
    """Delete at the end what was put into the shared folder meanwhile, but for the paths added to the set given."""
    first, keep = len(_made), set()
    yield keep
    for path in _made[first:]:
        if path not in keep:
            _delete(spark, path)
    _made[first:] = [p for p in _made[first:] if p in keep]


def last_path() -> str:
    """Where the last thing was stored that is still there."""
    return _made[-1]


def discard(spark: SparkSession, path: str | None) -> None:
    """Delete what was stored there."""
    if path in _made:
        _made.remove(path)
        _delete(spark, path)


def publish(fs, temp: str, name: str) -> None:
    """Give a whole file its name; a retried task replaces what an earlier try has left."""
    from pyarrow.fs import FileType

    if fs.get_file_info(name).type != FileType.NotFound:
        fs.delete_file(name)
    fs.move(temp, name)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage ends there.

    The written files outlive executors, so a lost one costs no recomputation.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, in rows and in bytes.

    The same bounds for all, as they hold for a session: what was planned before or is planned later is not changed.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shares(df: DataFrame, mb: int = 64) -> int:
    """Into how many parts to deal ``df``: as many as the session's shuffles have, or more where it is large.

    By the bytes of the files it is read from, as the planner knows them, so that a part stays of
    one size as the data grow; a table that is in no file has no known size.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 60)
    return max(partitions(df.sparkSession), -(-known // (mb << 20)))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def released() -> None:
    """Give back what the allocators of a Python worker hold free; a worker that waits for its next task keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the usual C library
    if trim:
        trim(0)


def trimmed(run: Callable) -> Callable:
    """``run`` over batches, with ``released`` once they are through."""

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            released()

    return all_of


def larger(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold ``size`` bytes."""
    held, total = [], 0
    for b in batches:
        held.append(b)
        total += b.nbytes
        if total >= size:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their partition and their place in it."""
    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        place = np.arange(at, at + b.num_rows)
        at += b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part)), pa.array(place)], names=[*b.schema.names, "__part", "__place"])


def ranked(rows: DataFrame, order: list, name: str, tag: str) -> DataFrame:
    """``rows`` with their place in an order, from 0, in the column ``name``; stored.

    Ranges of rows are numbered apart; the ranges' counts, one row each, give where each begins.
    """
    spark = rows.sparkSession
    kind = StructType([*rows.schema.fields, StructField("__part", LongType()), StructField("__place", LongType())])
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    own = stored(dealt.mapInArrow(_numbered, kind), f"{tag}-places")
    before = Window.partitionBy(F.lit(1)).orderBy("__begin_part").rowsBetween(Window.unboundedPreceding, -1)
    begin = own.groupBy(F.col("__part").alias("__begin_part")).agg(F.count("*").alias("__n")).select("__begin_part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__begin"))
    return stored(own.join(begin, F.col("__part") == F.col("__begin_part")).select(*rows.columns, (F.col("__begin") + F.col("__place")).alias(name)), tag)
