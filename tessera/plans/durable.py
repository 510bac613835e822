"""Cutting lineage in storage that outlives executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode a folder of our own where that is unset."""
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tessera-checkpoints-")
        atexit.register(shutil.rmtree, own, True)
        root = f"file://{own}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root.rstrip("/")


#: What this process has written and not yet deleted.
_made: list[str] = []


def fresh(spark: SparkSession, label: str) -> str:
    """A path for files, in the same folder."""
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df computed and stored: its plan is the stored rows."""
    folder(df.sparkSession)
    out = df.checkpoint()
    stored = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if stored.isDefined():
        _made.append(stored.get())
    return out


def discard(spark: SparkSession) -> None:
    """Delete all that this process has stored: results that still read it are lost, so write them first."""
    jvm = spark.sparkContext._jvm
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
