"""Session set-up shared by tests, the bench and the entry module."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: Whether shuffle files go when their query has ended, or only when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = 8, partitions: int = 8, name: str = "pagewright") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PAGEWRIGHT_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def importable_on_workers(spark: SparkSession) -> None:
    """Let Python workers started by this session import the package.

    A cluster gets the package by --py-files; for local workers the folder goes on their path.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in a local session one of our own where it is
    unset. On a cluster it must be set, as no folder of one machine will do."""
    sc = spark.sparkContext
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def durable(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder, so that a lost executor loses none of them."""
    root = shared_dir(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return df.checkpoint()


def passing(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of what `make` returns, computed once and kept. What `make` keeps by durable() on its way is removed when
    they are, and the shuffle files of each of its queries as that ends. Calls may be nested."""
    sc, root, before = spark.sparkContext, shared_dir(spark), spark.conf.get(CLEANUP, "false")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    base = sc.getCheckpointDir().rpartition("/")[0]  # each call of setCheckpointDir makes a folder in the one given
    own = f"{base}/passing-{uuid.uuid4().hex}"
    spark.conf.set(CLEANUP, "true")
    sc.setCheckpointDir(own)
    try:
        df = make()
        sc.setCheckpointDir(base)
        return durable(df)
    finally:
        sc.setCheckpointDir(base)
        spark.conf.set(CLEANUP, before)
        remove(spark, own)
