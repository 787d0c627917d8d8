"""Session helpers.

``get_session`` is for tests and local runs only; on a cluster the caller
owns the session and every operator just takes DataFrames.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

# Session settings every operator relies on: UTC wall clock, AQE with skew
# splitting, and a partial WindowGroupLimit for per-group top-k filters.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "vigil") -> SparkSession:
    master = master or os.environ.get("VIGIL_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("VIGIL_DRIVER_MEMORY", "16g"))
    )
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    """Pin the settings results depend on (time zone) and scale helpers."""
    for k, v in SESSION_DEFAULTS.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # pragma: no cover - immutable on some deployments
            pass


def shared_base(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    A local master (tests) may leave it unset and gets a folder under
    ``/tmp``; any other master must name one, because a folder on one machine
    is invisible to the others and later reads would miss rows."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on master {master}")
    spark.sparkContext.setCheckpointDir("/tmp/vigil-checkpoints")
    return "/tmp/vigil-checkpoints"


#: Folders that this process has named and not dropped.
_MADE: set[str] = set()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory."""
    path = f"{shared_base(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.add(path)
    return path


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``shared_dir`` once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)
    _MADE.discard(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every folder of ``shared_dir`` that is still there: for callers
    that have read or stored all results, since a returned frame may still
    read its last tables."""
    for path in sorted(_MADE):
        drop_dir(spark, path)


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a parquet table under the cluster's shared checkpoint
    directory (``spark.checkpoint.dir``) and read it back: later passes
    neither recompute nor re-plan the chain behind it, a lost executor does
    not force a recompute, and readers get column pruning.  (One job, where
    ``Dataset.checkpoint`` of an unpersisted plan runs it twice.)"""
    return cut_to(df, shared_dir(df.sparkSession, name))


def cut_to(df: DataFrame, path: str) -> DataFrame:
    """``cut_lineage`` into a named folder, for callers that drop it later."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
