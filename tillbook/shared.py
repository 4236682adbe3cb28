"""Intermediate tables, kept in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``, else below the context's checkpoint directory.

    Where neither is set, a local master gets a new local folder and any other master an error: its
    executors could not read each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tillbook-")
    return f"{root.rstrip('/')}/tillbook-{uuid.uuid4().hex}"


def write_and_read(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """``df`` as a written Parquet table: computed once, read many times, safe against lost
    executors, and pruned by its partition columns.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
