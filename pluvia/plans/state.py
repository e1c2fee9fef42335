"""State of a run as tables under one folder: cell state, parcels, scalars.

A folder is written beside its place and renamed when all of it is there, so that a reader never sees a part.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class State:
    """``cells`` (cell_id, p_cum_mm, q_cum_mm), ``parcels`` (cell_id, step0, tau, n, vol) that are still in the grid: from
    step0 on they wait in their cell for tau (without tau: as they were spawned), and ``scalars``: step (the last one done), dt_s, totals."""

    cells: DataFrame
    parcels: DataFrame
    scalars: dict


def save(path: str, cells: DataFrame, parcels: DataFrame, scalars: dict, **more: DataFrame) -> None:
    """``more``: further tables of the state, by name."""
    spark = cells.sparkSession
    fs, here, there = _paths(spark, path, path.rstrip("/") + ".part")
    fs.delete(there, True)
    part = str(there)
    cells.write.parquet(f"{part}/cells")
    parcels.write.parquet(f"{part}/parcels")
    for name, table in more.items():
        table.write.parquet(f"{part}/{name}")
    spark.createDataFrame([(json.dumps(scalars),)], "scalars string").coalesce(1).write.parquet(f"{part}/run")
    fs.delete(here, True)
    if not fs.rename(there, here):
        raise OSError(f"cannot rename {there} to {here}")


def _paths(spark: SparkSession, *paths: str):
    made = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return made[0].getFileSystem(spark._jsc.hadoopConfiguration()), *made


def load(spark: SparkSession, path: str, cells: int | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """(cells, parcels, scalars); ``cells`` checks that the state belongs to a grid of so many."""
    scalars = json.loads(spark.read.parquet(f"{path}/run").first()[0])
    state = spark.read.parquet(f"{path}/cells")
    if cells is not None and state.count() != cells:
        raise ValueError("the state belongs to another grid")
    return state, spark.read.parquet(f"{path}/parcels"), scalars


def read(spark: SparkSession, path: str, cells: int | None = None) -> State:
    return State(*load(spark, path, cells))
