"""``tidy`` and ``glance`` of every result as DataFrames, whatever its class."""

from __future__ import annotations

import inspect

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def _asks_for_session(f) -> bool:
    return "spark" in inspect.signature(f).parameters


def glance(result, spark: SparkSession) -> DataFrame:
    """One row (of a multivariate allocation one per variable) about a result."""
    found = result.glance(spark) if _asks_for_session(result.glance) else result.glance()
    if isinstance(found, DataFrame):
        return found
    return spark.createDataFrame(pd.DataFrame([{k: v for k, v in found.items() if v is not None}]))


def tidy(result, spark: SparkSession) -> DataFrame:
    """A row per stratum, stage, frame, visit or size of a result."""
    if hasattr(result, "tidy"):
        return result.tidy(spark)
    if hasattr(result, "stops_df"):
        return result.stops_df(spark)
    raise TypeError(f"{type(result).__name__} has no rows")
