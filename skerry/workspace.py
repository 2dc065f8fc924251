"""Intermediate tables in the folder that driver and executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only where that setting is
absent and all runs in one process (unit tests) a folder of our own is used instead; on a cluster a
missing setting is an error.  A written table cuts the lineage: a lost executor costs the tasks it
ran, not the work behind the table.  Tables that a returned plan still reads stay until
:func:`clear`, which an application calls once it has its results.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: str | None = None


def shared_root(spark: SparkSession) -> str:
    """Folder for this application's intermediate tables."""
    global _LOCAL_ROOT
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if _LOCAL_ROOT is None:
            _LOCAL_ROOT = tempfile.mkdtemp(prefix="skerry-")
        root = _LOCAL_ROOT
    return f"{root.rstrip('/')}/skerry/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that no returned plan reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(df: DataFrame) -> None:
    """Delete the files behind a :func:`materialize` result."""
    root = shared_root(df.sparkSession).split("://")[-1].replace("file:", "")
    folders = {name.rsplit("/", 1)[0] for name in df.inputFiles()}
    for folder in folders:
        if f"{root}/" in f"{folder}/":
            remove(df.sparkSession, folder)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application."""
    remove(spark, shared_root(spark))
