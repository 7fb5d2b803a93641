"""Session and shared-folder helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tessera", cpus: int | None = None) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, Arrow)."""
    n = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in spark.checkpoint.dir.

    Only a session on one machine (tests, a laptop) may do without: it gets a
    temporary folder, removed at its end. On a cluster a folder of one machine
    would lose data silently, so there a missing setting is a ValueError.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set; a cluster needs a folder there that all executors share")
        named = tempfile.mkdtemp(prefix="tessera-ckpt-")
        atexit.register(shutil.rmtree, named, True)
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage.

    Files survive the loss of an executor, unlike a local checkpoint. They are
    removed once the result is no longer referred to, where the session has
    spark.cleaner.referenceTracking.cleanCheckpoints (build_session sets it).
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, stem: str) -> str:
    """A fresh path under the shared folder, for tables that are written and read again; removed when the session ends."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{base}/{stem}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(there)  # only what exists can be marked
    fs.deleteOnExit(there)
    fs.delete(there, True)
    return path
