"""Folders that driver and executors share, and their files."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``; where none is set, a temporary one on one machine, an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return f"{shared.rstrip('/')}/siftwell/{uuid.uuid4().hex}"
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="siftwell-")


def _path(spark: SparkSession, folder: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, folder: str) -> bool:
    system, target = _path(spark, folder)
    return system.exists(target)


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names of a folder's entries; none where there is no folder."""
    system, target = _path(spark, folder)
    return sorted(entry.getPath().getName() for entry in system.listStatus(target)) if system.exists(target) else []


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder, or nothing where there is none."""
    system, target = _path(spark, folder)
    system.delete(target, True)


def broadcast_small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Broadcast a table that is counted to have at most ``most`` rows; a larger one is left to the planner."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
