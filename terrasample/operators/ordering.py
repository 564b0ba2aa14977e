"""Order within groups without one task per group.

A group can be a third of a frame. Both helpers cut a group into buckets along the order, aggregate by bucket before
the shuffle, and sort only within buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lowest(df: DataFrame, group: list[str], u: str, tie: str, n: str, count: str) -> DataFrame:
    """``df`` with a boolean ``chosen``: the ``n`` rows of each group with the lowest (``u``, ``tie``).

    ``u`` is uniform on (0, 1), ``count`` the rows of the group. About sqrt(count) buckets are counted; only the bucket in
    which the n-th row falls is sorted.
    """
    bucket = F.floor(F.col(u) * F.ceil(F.sqrt(F.col(count)))).cast("long")
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_rows"), F.first(n).alias("_n"))
    before = F.coalesce(F.sum("_rows").over(W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edges = counts.withColumn("_before", before).where((F.col("_before") < F.col("_n")) & (F.col("_before") + F.col("_rows") >= F.col("_n")))
    edges = edges.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_edge"), (F.col("_n") - F.col("_before")).alias("_left"))
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    rows = rows.join(edges, same, "left").drop(*[f"_g{i}" for i in range(len(group))])
    # only rows of the edge bucket share a window; every other bucket has one of its own
    place = F.row_number().over(W.partitionBy(*group, "_bucket").orderBy(u, tie))
    chosen = F.when(F.col("_edge").isNull(), F.col(n) > 0).when(F.col("_bucket") == F.col("_edge"), place <= F.col("_left")).otherwise(F.col("_bucket") < F.col("_edge"))
    return rows.withColumn("chosen", chosen).drop("_bucket", "_edge", "_left")


def running_total(df: DataFrame, group: list[str], order: list[str], bucket: Column, value: str, name: str) -> DataFrame:
    """``df`` with the running sum of ``value`` along ``order`` within each group. ``bucket`` must not fall along it."""
    rows = df.withColumn("_bucket", bucket)
    sums = rows.groupBy(*group, "_bucket").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_b"), before.alias("_before"))
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col("_bucket") == F.col("_b")]
    rows = rows.join(sums, same).drop("_b", *[f"_g{i}" for i in range(len(group))])
    within = F.sum(value).over(W.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn(name, F.col("_before") + within).drop("_bucket", "_before")


def with_index(df: DataFrame, name: str) -> DataFrame:
    """``df`` with consecutive numbers from 1 in its present order; only the partition sizes are collected."""
    marked = df.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = sorted((r["_part"], r["count"]) for r in marked.groupBy("_part").count().collect())
    offset, offsets = 0, []
    for part, count in sizes:
        offsets += [F.lit(part), F.lit(offset)]
        offset += count
    start = F.create_map(*offsets)[F.col("_part")] if offsets else F.lit(0)
    return marked.withColumn(name, start + F.col("_at") + 1).drop("_part", "_at")
