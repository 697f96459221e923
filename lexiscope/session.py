"""Session helpers.

A cluster names its shared checkpoint folder in ``spark.checkpoint.dir``; we
read it from the session and only set our own when it is unset (tests, local
runs).
"""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "lexiscope") -> SparkSession:
    """Return the active session, or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # parallelism first: coalesce small shuffles no further than one
        # partition per core (CPU-heavy text stages follow small shuffles)
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16k")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.driver.memory", os.environ.get("LEXISCOPE_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    Uses ``spark.checkpoint.dir`` when the cluster sets it.  Only a local
    master (tests) may do without: it gets a private folder under the system
    temp dir, which one machine sees as a whole.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="lexiscope-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """Path for a written intermediate table next to the checkpoints, in one folder per run."""
    scope = getattr(spark.sparkContext, "_lexiscope_scope", None)
    return "/".join([_run_folder(spark), *([scope] if scope else []), name])


def _run_folder(spark: SparkSession) -> str:
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{spark.sparkContext.applicationId}"


def begin_scope(spark: SparkSession, name: str, still_read: DataFrame) -> None:
    """Write further intermediate tables under ``name`` and delete those of earlier scopes.

    For steps whose results are saved before the next step begins: what an
    earlier scope wrote is no longer needed then, except where ``still_read``
    reads it.  Tables written outside scopes stay.
    """
    sc = spark.sparkContext
    past = getattr(sc, "_lexiscope_scopes", [])
    files = still_read.inputFiles() if past else []
    kept = [scope for scope in past if any(f"/{scope}/" in f for f in files)]
    for scope in set(past) - set(kept):
        _delete(spark, f"{_run_folder(spark)}/{scope}")
    sc._lexiscope_scope = f"{name}-{uuid4().hex}"
    sc._lexiscope_scopes = [*kept, sc._lexiscope_scope]


def end_scope(spark: SparkSession) -> None:
    """Write further intermediate tables outside scopes; the last scope's tables stay until the next one begins."""
    spark.sparkContext._lexiscope_scope = None


def drop_intermediate(spark: SparkSession) -> None:
    """Delete the intermediate tables of this run; results that still read them must be saved first."""
    _delete(spark, _run_folder(spark))


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete one intermediate table of this run."""
    if path.startswith(_run_folder(spark) + "/"):
        _delete(spark, path)


def drop_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of a plan when its driver has collected the plan; ask it to do so now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Workers import the functions that plans refer to; they need the package
    even where it is not installed on every machine.
    """
    sc = spark.sparkContext
    if getattr(sc, "_lexiscope_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="lexiscope-ship-"), "lexiscope"), "zip",
                                  root_dir=root, base_dir="lexiscope")
    sc.addPyFile(archive)
    sc._lexiscope_shipped = True
