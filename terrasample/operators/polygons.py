"""Points in polygons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasample.functions.checks import requires
from terrasample.sources.areaframe import _rings, read_wkb


def inside(x: np.ndarray, y: np.ndarray, polygons: list[list[np.ndarray]]) -> np.ndarray:
    """Whether points lie in any polygon: crossings of a ray to the right are odd, holes included."""
    out = np.zeros(len(x), dtype=bool)
    for rings in polygons:
        odd = np.zeros(len(x), dtype=bool)
        for ring in rings:
            x0, y0 = ring[:, 0], ring[:, 1]
            x1, y1 = np.roll(x0, -1), np.roll(y0, -1)
            for a, b, c, d in zip(x0, y0, x1, y1, strict=True):
                if b == d:
                    continue
                across = (b > y) != (d > y)
                odd ^= across & (x < (c - a) * (y - b) / (d - b) + a)
        out |= odd
    return out


def points_in_polygons(points: DataFrame, shapes: DataFrame, cell: float, x: str = "x", y: str = "y", unit: str = "unit", geometry: str = "geom_wkb") -> DataFrame:
    """``points`` with ``cell`` added, the first unit (by name) of the polygons they lie in, null for none.

    Polygons are dealt to the square buckets of side ``cell`` that their bounding boxes touch and points to their own, so
    only points and polygons of the same bucket meet; the test itself is vectorised by polygon.
    """
    requires(points, ["unit", x, y], "the points")
    requires(shapes, [unit, geometry], "the polygons")

    def boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for name, data in zip(part["_u"], part["_g"], strict=True):
                if data is None:
                    continue
                kind, c = read_wkb(bytes(data))
                flat = np.concatenate([r for rings in _rings(c, kind) for r in rings])
                lo, hi = np.floor(flat.min(0) / cell).astype(int), np.floor(flat.max(0) / cell).astype(int)
                rows += [(name, bytes(data), i, j) for i in range(lo[0], hi[0] + 1) for j in range(lo[1], hi[1] + 1)]
            yield pd.DataFrame(rows, columns=["_u", "_g", "_i", "_j"])

    dealt = shapes.select(F.col(unit).cast("string").alias("_u"), F.col(geometry).alias("_g")).mapInPandas(boxes, "_u string, _g binary, _i long, _j long")
    own = points.select(F.col("unit").alias("_p"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    own = own.withColumn("_i", F.floor(F.col("_x") / cell)).withColumn("_j", F.floor(F.col("_y") / cell))

    @F.pandas_udf("boolean")
    def within(a: pd.Series, b: pd.Series, g: pd.Series) -> pd.Series:
        out = np.zeros(len(a), dtype=bool)
        for data, at in g.groupby(g, sort=False).groups.items():
            kind, c = read_wkb(bytes(data))
            out[at] = inside(a.loc[at].to_numpy(float), b.loc[at].to_numpy(float), _rings(c, kind))
        return pd.Series(out)

    found = own.join(dealt, ["_i", "_j"]).where(within(F.col("_x"), F.col("_y"), F.col("_g"))).groupBy("_p").agg(F.min("_u").alias("cell"))
    return points.join(found, F.col("unit") == F.col("_p"), "left").drop("_p")
