"""Running point-estimator totals over a stream of field hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_totals(hits: DataFrame, time: str = "ts", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Sum of y over expected hits and the number of hits by window of field time. Hits later than ``late`` are dropped by
    the watermark; the sums over windows add up to the point estimator's total."""
    rows = hits.withWatermark(time, late).groupBy(F.window(time, window).alias("w"))
    return rows.agg(F.sum(F.col("y") / F.col("expected_hits")).alias("total"), F.count(F.lit(1)).alias("n_hits")).select("w.start", "w.end", "total", "n_hits")
