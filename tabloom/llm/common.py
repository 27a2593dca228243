"""Helpers shared by the text operators: table access, Arrow batches, shared scratch tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tabloom.session import scratch_table_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str, written: list[str] | None = None) -> DataFrame:
    """Write ``df`` to a fresh table in the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor re-reads files instead of recomputing, and
    values such as generated row ids stay the same in every later use.  The
    table stays; its path is added to ``written`` for a later :func:`discard`.
    """
    spark = df.sparkSession
    path = scratch_table_path(spark, name)
    if written is not None:
        written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, written: list[str]) -> None:
    """Delete tables of :func:`materialize` that no frame still to be read depends on."""
    for name in written:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parallel(df: DataFrame, at_least: int | None = None) -> int:
    """Number of shuffle partitions configured for the session."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(n, at_least or 1)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(b)
                if out is not None and out.num_rows:
                    yield out
    return df.mapInArrow(run, schema)


def apart(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt anew, so that Python steps before and after run in different tasks.

    Steps of one task each need a worker at the same time, and executors keep
    all the workers that any task needed.
    """
    return df.repartition(*by)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    col = batch.column(name)
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Arrow batches between Spark and Python hold at most ``rows`` rows, for whole texts travel in them.

    A batch lies in the executor beside its heap and in the Python worker, once
    on the way in and once on the way out.  A smaller setting of the session stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def release() -> None:
    """Give memory that freed arrays held back to the system.

    A worker serves one stage after another; without this it keeps the most
    that any of them took beside the executor's heap.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
