"""Every query of the engine by name, with its oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pluvia.plans import queries as plans
from pluvia.plans import queries_features, queries_networks  # noqa: F401  register their queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(plans.ORACLES)
