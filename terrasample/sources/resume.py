"""Resumable runs: units of work that are done are found by their key and not done again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException


def run_missing(spark: SparkSession, tasks: DataFrame, key: str, path: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Append ``work(tasks)`` for the tasks whose ``key`` is not among the results at ``path``; returns all results."""
    try:
        done = spark.read.parquet(path)
        left = tasks.join(done.select(key).distinct(), key, "left_anti")
    except AnalysisException:
        left = tasks
    work(left).write.mode("append").parquet(path)
    return spark.read.parquet(path)
