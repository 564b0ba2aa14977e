"""The tables that plots are drawn from. Longitude comes first wherever coordinates are geographic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasample.operators.costcurve import CostCurve
from terrasample.operators.routing import route_segments
from terrasample.operators.schedule import Schedule
from terrasample.operators.select import Sample


def axes(coords: tuple[str, ...]) -> tuple[str, str]:
    return (coords[1], coords[0]) if tuple(coords) == ("lat", "lon") else (coords[0], coords[1])


def sample_points(sample: Sample) -> DataFrame:
    """``unit, x, y, stratum, sampled, pi`` of every unit of the frame."""
    a, b = axes(sample.design.coords)
    return sample.df.select("unit", F.col(a).alias("x"), F.col(b).alias("y"), sample.stratum().alias("stratum"), "sampled", "pi")


def schedule_segments(spark: SparkSession, schedule: Schedule, units: DataFrame, coords: tuple[str, str]) -> DataFrame:
    """Segments of all routes with base, team and day."""
    from pyspark.sql import Window as W

    rows = schedule.tidy(spark).withColumn("depot", F.col("base"))
    number = rows.select("base", "route").distinct().withColumn("id", F.row_number().over(W.orderBy("base", "route")))  # a few rows
    stops = rows.join(number, ["base", "route"]).select(F.col("id").alias("route"), "stop", "unit", "depot", "base", "team", "day")
    drawn = route_segments(stops.select("route", "stop", "unit", "depot"), units, coords)
    return drawn.join(stops.select("route", "base", "team", "day").distinct(), "route")


def frontier_lines(frontier: DataFrame) -> DataFrame:
    """Cost against variance, or against size where the frontier has no variable."""
    across = F.col("variance_mean" if "variance_mean" in frontier.columns else "n").cast("double")
    return frontier.select("n", across.alias("x"), F.col("cost_mean").alias("y"), F.col("cost_sd").alias("spread"))


def curve_lines(spark: SparkSession, curve: CostCurve, points: int = 100) -> DataFrame:
    """The fitted curve between its smallest and largest size."""
    low, high = min(p[0] for p in curve.points), max(p[0] for p in curve.points)
    n = spark.range(points).select((F.lit(low) + F.col("id") * ((high - low) / max(1, points - 1))).alias("n"))
    return n.select("n", *curve.columns(F.col("n")))
