"""Fitted transforms on a stream of new rows.

The reference has no streaming logic of its own.  What carries over is the
apply side: every fitted object here (imputer, scaler, encoders, feature
pipeline, model) is a stateless projection, so the same object that was
fitted on a batch table can be applied to a Structured Streaming source.
Nothing is refitted on the stream (train/serve consistency).  Fits that need
a join against a distributed table (very large category tables) are
stream-static joins, which Structured Streaming supports.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tabloom.session import checkpoint_dir


def read_parquet_stream(spark: SparkSession, path: str, schema: T.StructType,
                        max_files_per_trigger: int | None = None) -> DataFrame:
    """New parquet files in ``path`` as a stream (schema must be given)."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def apply_fitted(stream: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Apply fitted ``apply`` functions (or any stateless DataFrame -> DataFrame) in order."""
    out = stream
    for step in steps:
        out = step(out)
    return out


def write_table_stream(df: DataFrame, path: str, name: str, trigger_once: bool = True,
                       checkpoint: str | None = None):
    """Append the transformed stream to a parquet table.

    The checkpoint goes under the cluster's shared checkpoint folder, so a
    restarted query resumes exactly where it stopped (file sink + checkpoint
    give exactly-once output).
    """
    ckpt = checkpoint or f"{checkpoint_dir(df.sparkSession).rstrip('/')}/streams/{name}"
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", ckpt) \
        .outputMode("append").queryName(name)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="1 minute")
    return w.start()


def predict_stream(spark: SparkSession, source: str, schema: T.StructType, steps: Sequence[Callable],
                   model, out_path: str, name: str = "predictions"):
    """Score new files with a fitted feature chain and model; returns the running query."""
    s = apply_fitted(read_parquet_stream(spark, source, schema), steps)
    scored = model.predict(s)
    return write_table_stream(scored, out_path, name)
