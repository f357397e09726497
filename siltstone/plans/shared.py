"""Shared storage for what a plan reads twice."""

from __future__ import annotations

import re
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as ``spark.checkpoint.dir`` names it.

    Where that is unset, a cluster's warehouse holds it. A temporary folder is made only for a local
    master (tests, one machine), as there the driver's disk is the executors' disk.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        local = context.master == "local" or context.master.startswith("local[")
        own = tempfile.mkdtemp(prefix="siltstone-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_siltstone"
        context.setCheckpointDir(named or own)
    return named or context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder in whatever store the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def sweep(spark: SparkSession, hours: float) -> list[str]:
    """Delete what operators stored in the shared folder and nothing has changed for so many hours; gives the names.

    Results are read lazily from there, so only the caller knows when nobody needs them any more: take more hours than
    a query runs. Only folders that are named as operators name theirs are touched; checkpoints Spark removes
    itself where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    top = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files, gone = top.getFileSystem(spark._jsc.hadoopConfiguration()), []
    for f in files.listStatus(top) if files.exists(top) else []:
        name, age = f.getPath().getName(), time.time() - f.getModificationTime() / 1000
        if f.isDirectory() and age > hours * 3600 and re.fullmatch(r"[a-z]+-[0-9a-f]{32}", name):
            files.delete(f.getPath(), True)
            gone.append(name)
    return sorted(gone)
