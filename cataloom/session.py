"""What operators need of a session: the shared folder, written tables, and the package on the workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a written table is broadcast.
BROADCAST_ROWS = 500_000
_sent = ""


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; an own one only where it is unset in local mode."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="cataloom-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: it outlives lost executors, and nothing recomputes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cataloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def small(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table with a broadcast hint if it has at most ``most`` rows; else as it is, and joins shuffle."""
    return F.broadcast(table) if table.count() <= most else table


def ship(spark: SparkSession | None = None) -> None:
    """Python workers get this package as a zip, once a session."""
    global _sent
    spark = spark or SparkSession.active()
    if _sent == spark.sparkContext.applicationId:
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="cataloom-package-"))
    atexit.register(shutil.rmtree, at, True)
    spark.sparkContext.addPyFile(shutil.make_archive(str(at / root.name), "zip", root.parent, root.name))
    _sent = spark.sparkContext.applicationId
