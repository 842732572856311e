"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one uses the machine's temporary folder, a cluster must have it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), "factloom-scratch")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: its plan is run once however often it is used, and a lost executor costs no recomputation.

    The files go when the application ends, or before that by ``forget``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/factloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` that nothing reads any more."""
    path = getattr(df, "_stored_path", None)
    if path:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
