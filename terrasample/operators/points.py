"""Points in sampled cells and the hits they can be expected to make."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasample.functions.checks import all_true, no_rows, requires, whole
from terrasample.functions.columns import uniform
from terrasample.operators.select import Sample, by_stratum


def points_per_cell(sample: Sample, points, need_whole: bool = True) -> Column:
    """Points of a cell: a number, a column's name, or numbers by stratum. Expected hits allow fractions."""
    if isinstance(points, str):
        requires(sample.df, [points], "the sample")
        out = F.col(points)
    elif isinstance(points, Mapping):
        missing = [k for k in sample.design.n if k not in points]
        if missing:
            raise ValueError(f"points_per_cell does not cover the strata {', '.join(missing)}")
        out = by_stratum({k: float(v) for k, v in points.items()}, sample.stratum())
    else:
        out = F.lit(float(points))
    good = (out >= 1) & ((out == F.floor(out)) if need_whole else F.lit(True))
    all_true(sample.df, p=(good, f"points_per_cell must be {'whole numbers of ' if need_whole else ''}at least 1"))
    return out


def cell_sides(cell_size) -> tuple[float, float]:
    sides = tuple(cell_size) if isinstance(cell_size, (list, tuple)) else (cell_size, cell_size)
    if len(sides) != 2 or min(sides) <= 0:
        raise ValueError("cell_size must be one or two positive numbers")
    return float(sides[0]), float(sides[1])


def select_points(sample: Sample, points, cell_size, layout: str = "random", seed: int = 1) -> DataFrame:
    """Points in each sampled cell: independent uniforms, or a k1 x k2 lattice with one random start per cell, where k1 is
    the largest divisor of the number of points not above its root. Columns ``unit, point``, the coordinates, ``pi_cell``,
    ``points_in_cell`` and ``density``."""
    if layout not in ("random", "systematic"):
        raise ValueError("layout must be random or systematic")
    seed = whole(seed, "seed")
    a, b = sample.design.coords
    sides = cell_sides(cell_size)
    m = points_per_cell(sample, points)
    rows = sample.sampled().withColumn("_m", m.cast("int"))
    rows = rows.withColumn("point", F.explode(F.sequence(F.lit(1), F.col("_m"))))
    if layout == "random":
        u = [uniform(seed, F.col("unit"), F.col("point"), axis) for axis in ("a", "b")]
    else:
        k1 = F.expr("array_max(filter(sequence(1, cast(floor(sqrt(_m)) as int)), k -> _m % k = 0))")
        rows = rows.withColumn("_k1", k1).withColumn("_k2", (F.col("_m") / F.col("_k1")).cast("int"))
        start = [uniform(seed, F.col("unit"), axis) for axis in ("a", "b")]
        i, j = (F.col("point") - 1) % F.col("_k1"), F.floor((F.col("point") - 1) / F.col("_k1"))
        u = [(i + start[0]) / F.col("_k1"), (j + start[1]) / F.col("_k2")]
    return rows.select(
        "unit", "point", (F.col(a) + (u[0] - 0.5) * sides[0]).alias(a), (F.col(b) + (u[1] - 0.5) * sides[1]).alias(b),
        F.col("pi").alias("pi_cell"), F.col("_m").alias("points_in_cell"), (F.col("pi") * F.col("_m") / math.prod(sides)).alias("density"),
    )


def expected_hits(areas: DataFrame, sample: Sample, points, cell_size) -> DataFrame:
    """Expected hits of each establishment over all cells of the frame, sampled or not."""
    requires(areas, ["establishment", "unit", "area"], "areas")
    sides = cell_sides(cell_size)
    m = points_per_cell(sample, points, need_whole=False)
    cells = sample.df.select("unit", (F.col("pi") * m / math.prod(sides)).alias("_d"))
    no_rows(areas.join(cells, "unit", "left_anti"), "areas refer to cells that are not in the frame")
    both = areas.join(cells, "unit")
    return both.groupBy("establishment").agg(F.sum(F.col("_d") * F.col("area")).alias("expected_hits"))
