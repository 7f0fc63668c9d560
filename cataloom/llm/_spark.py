"""Spark helpers of the operators: lineage cuts, size-checked joins, worker paths."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a written table may be broadcast (six columns of 8 bytes at most: 48 MB).
BROADCAST_KEYS = 1_000_000
_SENT = ""


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where it is unset, and then only in local mode (tests), an own folder is used.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    there = spark.sparkContext.getCheckpointDir()
    if there:
        return there
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    at = tempfile.mkdtemp(prefix="cataloom-")
    atexit.register(shutil.rmtree, at, True)
    own = f"file://{at}"
    spark.sparkContext.setCheckpointDir(own)
    return own


def table(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Later jobs neither recompute it nor depend on the executor that made it, and its
    size on disk is known to the planner.  The files go when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cataloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def hint(small: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """``small`` (a written table) with a broadcast hint if it has at most ``limit`` rows, else as it is."""
    return F.broadcast(small) if small.count() <= limit else small


def workers_find_package(spark: SparkSession) -> None:
    """Python workers import this package from a zip that Spark hands to every executor, wherever it runs."""
    global _SENT
    if _SENT == spark.sparkContext.applicationId:
        return
    root = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="cataloom-package-"))
    atexit.register(shutil.rmtree, at, True)
    made = shutil.make_archive(str(at / root.name), "zip", root.parent, root.name)
    spark.sparkContext.addPyFile(made)
    _SENT = spark.sparkContext.applicationId


def clashless(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, starting with ``stem``."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def drop(df: DataFrame) -> None:
    """Deletes the files of a written table that nothing will read any more."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent() if df.inputFiles() else None
    if at is not None and at.getName().startswith("cataloom-"):
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
