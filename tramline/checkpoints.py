"""Cutting lineage through the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, a temporary one of
    our own in local mode, in which driver and executors are one process; on a cluster
    that would be a folder the executors cannot see, so it is an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(spark, "_tramline_scratch"):
        spark._tramline_scratch = "file://" + tempfile.mkdtemp(prefix="tramline-")
    return spark._tramline_scratch


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write the rows into the shared folder and read them back."""
    path = f"{shared_folder(df.sparkSession)}/tramline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
