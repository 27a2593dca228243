"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the library depends on.  ANSI mode stays on (Spark 4 default); the
# operators use try_* functions where the reference coerces bad values.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tabloom", extra: dict | None = None) -> SparkSession:
    """Return the active session, or build one with the library defaults.

    On a cluster the session normally exists already (spark-submit); then only
    the SQL settings that are still unset are filled in.
    """
    active = SparkSession.getActiveSession()
    if active is not None and master is None:
        for k, v in _DEFAULTS.items():
            if k.startswith("spark.sql.") and active.conf.get(k, None) is None:
                active.conf.set(k, v)
        return active
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scale_settings(input_bytes: int, cores: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings a job at ``input_bytes`` of input on ``cores`` cores should start from.

    * ``spark.sql.files.maxPartitionBytes`` ~ 256 MB per scan task;
    * ``spark.sql.shuffle.partitions`` high enough that a shuffle of the whole
      input gives ~256 MB partitions (AQE coalesces small ones back, and
      splits skewed ones, so erring high is cheap), at least 2x the cores;
    * AQE advisory size matching the scan size.
    At 100 TB this gives ~400k shuffle partitions; on local[8] with the test
    data it stays at the minimum.
    """
    shuffle = max(2 * cores, int(input_bytes // target_partition_bytes) + 1)
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins.  Only a session whose driver and
    executors are one process (``local`` masters) may go without it; it gets a
    private scratch folder.  Anywhere else an unset folder is an error, since
    executors would write to disks that the others cannot read.  The folder is
    registered with the context once (each registration would add a new
    sub-folder).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = os.path.join(tempfile.mkdtemp(prefix="tabloom-ckpt-"), "ckpt")
        spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Used before iterative work (tuning loops) so that a lost executor
    recomputes from the checkpoint files rather than from the whole lineage.
    Never a local checkpoint: those die with the executor.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for intermediate tables."""
    base = checkpoint_dir(spark)
    return f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
