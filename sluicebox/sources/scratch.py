"""Intermediate results of jobs that run in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder, which the driver and all executors share.

    Spark takes it from ``spark.checkpoint.dir``.  A session of this machine
    alone gets a temporary folder where that is unset; a cluster is refused.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sluicebox-"))
    return context.getCheckpointDir()


def folder(spark: SparkSession) -> str:
    """A new folder in the checkpoint folder."""
    return f"{_shared(spark)}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and written to the checkpoint folder."""
    _shared(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df, computed once, as Parquet in the checkpoint folder: small to read, and Spark knows its size."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
