"""List frames against area frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasample.functions.checks import distinct, no_rows, requires
from terrasample.operators.select import infer_coords


@dataclass(frozen=True)
class Overlap:
    """``list`` with ``cell`` and ``domain`` ('ab' or 'b'); ``cells`` with ``domain`` ('ab' or 'a'), ``n_listed`` and
    ``listed_units``."""

    list: DataFrame
    cells: DataFrame


def frame_overlap(units: DataFrame, cells: DataFrame, cell_size: float = 1.0, coords: list[str] | None = None, pairs: DataFrame | None = None, order: str = "unit") -> Overlap:
    """Put each listed unit into the cell whose square it lies in (Chebyshev nearest centre, the first by ``order`` of
    equals), or into the cell that ``pairs`` names.

    A square can only hold points of its own and the eight neighbouring buckets of side ``cell_size``, so the join is an
    equi-join on buckets: each cell goes to nine of them, and the nearest is a minimum, not a sort.
    """
    coords = infer_coords(cells, coords)
    a, b = coords
    requires(units, ["unit", a, b], "the list")
    requires(cells, ["unit", order], "the cells")
    distinct(units, "unit", "listed units that are not distinct")
    distinct(cells, "unit", "cells that are not distinct")
    size = float(cell_size)

    def bucket(c: str):
        return F.floor(F.col(c) / size).cast("long")

    left = units.withColumn("_i", bucket(a)).withColumn("_j", bucket(b))
    near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    right = cells.select(F.col("unit").alias("_cell"), F.col(order).alias("_ord"), F.col(a).alias("_a"), F.col(b).alias("_b"), bucket(a).alias("_ci"), bucket(b).alias("_cj"))
    right = right.withColumn("_di", F.explode(near)).withColumn("_dj", F.explode(near)).withColumn("_i", F.col("_ci") + F.col("_di")).withColumn("_j", F.col("_cj") + F.col("_dj"))
    distance = F.greatest(F.abs(F.col(a) - F.col("_a")), F.abs(F.col(b) - F.col("_b")))
    found = left.join(right, ["_i", "_j"]).withColumn("_d", distance).where(F.col("_d") <= size / 2 + 1e-9)
    found = found.groupBy("unit").agg(F.min(F.struct("_d", "_ord", "_cell"))["_cell"].alias("cell"))
    placed = units.join(found, "unit", "left")
    if pairs is not None:
        requires(pairs, ["unit", "cell"], "pairs")
        no_rows(pairs.join(units, "unit", "left_anti"), "pairs name units that are not in the list")
        no_rows(pairs.join(cells.select(F.col("unit").alias("cell")), "cell", "left_anti"), "pairs name unknown cells", "cell")
        placed = placed.join(pairs.select("unit", F.col("cell").alias("_given")), "unit", "left").withColumn("cell", F.coalesce("_given", "cell")).drop("_given")
    placed = placed.withColumn("domain", F.when(F.col("cell").isNull(), "b").otherwise("ab"))
    by_cell = placed.where("cell is not null").groupBy(F.col("cell").alias("_cell")).agg(F.count(F.lit(1)).alias("n_listed"), F.array_sort(F.collect_list("unit")).alias("listed_units"))
    joined = cells.join(by_cell, F.col("unit") == F.col("_cell"), "left").drop("_cell")
    joined = joined.withColumn("n_listed", F.coalesce("n_listed", F.lit(0))).withColumn("domain", F.when(F.col("n_listed") > 0, "ab").otherwise("a"))
    return Overlap(placed, joined)
