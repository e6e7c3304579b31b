"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only in a local session where neither it nor the context has one, a temporary folder is set. On a cluster it has to be named: executors can't reach a folder of the driver."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        if not named:
            atexit.register(shutil.rmtree, named := tempfile.mkdtemp(prefix="lectern-"), ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder and read from there: later uses don't compute them again and survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, most: int = 50_000) -> DataFrame:
    """The rows with a broadcast hint if there are at most so many (counted, a limit beyond it), else without one: Spark then joins by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
