"""Cutting the lineage of iterative plans in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; unset, a temporary one in local mode only."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "pluvia-checkpoints")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return spark.conf.get("spark.checkpoint.dir").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint below the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows over all tasks by ``key``: what is read from one file would be one task's, with all that is made of it."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
