"""Travel between units, and what field work costs."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasample.functions.checks import all_true, distinct, no_rows, requires
from terrasample.functions.columns import euclidean, haversine
from terrasample.operators.select import Sample, infer_coords


@dataclass(frozen=True)
class TravelMatrix:
    """Long travel table ``from, to, travel``. It need not be symmetric."""

    df: DataFrame
    units: DataFrame
    method: str
    unit: str
    detour: float = 1.0
    coords: tuple[str, ...] = ()
    #: Travel as an expression of two points' coordinates, where it follows from them.
    price: Callable[[Column, Column, Column, Column], Column] | None = None

    def between(self, rows: DataFrame, start: str, end: str, name: str) -> DataFrame:
        """``rows`` with the travel from the unit in column ``start`` to that in ``end``, null where there is none. Travel that
        follows from coordinates is computed for these pairs only, not for all pairs of the matrix."""
        if self.price is None:
            pairs = self.df.select(F.col("from").alias("_from"), F.col("to").alias("_to"), F.col("travel").alias(name))
            return rows.join(pairs, (F.col(start) == F.col("_from")) & (F.col(end) == F.col("_to")), "left").drop("_from", "_to")
        a, b = self.coords
        for k, unit in enumerate((start, end)):
            point = self.units.select(F.col("unit").alias(f"_u{k}"), F.col(a).cast("double").alias(f"_a{k}"), F.col(b).cast("double").alias(f"_b{k}"))
            rows = rows.join(point, F.col(unit) == F.col(f"_u{k}"), "left")
        ends = [f"_{c}{k}" for k in (0, 1) for c in "ab"]
        return rows.withColumn(name, self.price(*map(F.col, ends))).drop("_u0", "_u1", *ends)

    def square(self, names: list[str]) -> np.ndarray:
        """A dense square for a solver, only of the units it plans."""
        at = {u: i for i, u in enumerate(names)}
        some = F.broadcast(self.df.sparkSession.createDataFrame([(n,) for n in names], f"name {dict(self.df.dtypes)['from']}"))  # what a square has room for
        wanted = self.df.join(some, F.col("from") == F.col("name"), "left_semi").join(some, F.col("to") == F.col("name"), "left_semi")
        out = np.full((len(names), len(names)), np.nan)
        pdf = wanted.toPandas()
        pdf = pdf[pdf["from"].isin(at) & pdf["to"].isin(at)]
        out[pdf["from"].map(at).to_numpy(), pdf["to"].map(at).to_numpy()] = pdf["travel"].to_numpy(float)
        np.fill_diagonal(out, 0.0)
        if np.isnan(out).any():
            i, j = np.argwhere(np.isnan(out))[0]
            raise ValueError(f"no travel from {names[i]} to {names[j]}")
        return out

    def __repr__(self) -> str:
        return f"<travel, {self.method}, in {self.unit}>"


def travel_matrix(
    points: DataFrame | Sample,
    method: str | None = None,
    matrix: DataFrame | None = None,
    unit: str | None = None,
    detour: float = 1.0,
    bases: DataFrame | None = None,
    speed: float | None = None,
    coords: list[str] | None = None,
    **server,
) -> TravelMatrix:
    """Travel between all pairs of points: of a sample only the sampled ones. ``bases`` come first; ``speed`` turns
    distances into minutes; ``detour`` multiplies straight lines. A supplied ``matrix`` has columns from, to, travel. Method
    'osrm' asks a routing server (``server``, ``measure``, ``profile``, ``block``, ``fetch``, see ``sources.osrm``)."""
    if isinstance(points, Sample):
        coords = coords or list(points.design.coords)
        points = points.sampled()
    coords = infer_coords(points, coords)
    requires(points, ["unit"], "the points")
    if bases is not None:
        requires(bases, ["unit", *coords], "the bases")
        points = bases.select("unit", *coords).unionByName(points.select("unit", *coords))
    distinct(points, "unit", "units that are not distinct")
    if detour < 1:
        raise ValueError("detour must be at least 1")
    if matrix is not None:
        requires(matrix, ["from", "to", "travel"], "the matrix")
        all_true(matrix, t=((F.col("travel") >= 0) & ~F.isnan("travel"), "travel must not be missing or negative"))
        no_rows(points.join(matrix.select(F.col("from").alias("unit")), "unit", "left_anti"), "units without travel")
        return TravelMatrix(matrix.select("from", "to", "travel"), points, "supplied", unit or "travel", 1.0, tuple(coords))
    method = method or ("haversine" if coords == ["lat", "lon"] else "euclidean")
    if method == "osrm":
        from terrasample.sources.osrm import osrm_table

        if coords != ["lat", "lon"]:
            raise ValueError("method osrm needs lat and lon")
        return osrm_table(points, **server)[0]
    if method not in ("haversine", "euclidean") or server:
        raise ValueError("method must be haversine, euclidean or osrm, and only osrm takes a server's options")
    a, b = coords
    left = points.select(F.col("unit").alias("from"), F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))
    right = points.select(F.col("unit").alias("to"), F.col(a).cast("double").alias("_a2"), F.col(b).cast("double").alias("_b2"))
    name = "km" if method == "haversine" else "distance"
    if speed is not None:
        if speed <= 0:
            raise ValueError("speed must be positive")
        name = "min"

    def price(a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
        far = (haversine if method == "haversine" else euclidean)(a1, b1, a2, b2) * detour
        return far if speed is None else far / speed * 60

    far = price(F.col("_a"), F.col("_b"), F.col("_a2"), F.col("_b2"))
    df = left.crossJoin(right).select("from", "to", far.alias("travel"))  # a matrix is all pairs
    return TravelMatrix(df, points, method, unit or name, detour, (a, b), price)


@dataclass(frozen=True)
class CostModel:
    """Cost of field work. ``interviews_per_unit`` is a number, numbers by unit, or a function of a list of units."""

    per_travel: float = 1.0
    per_unit: float = 0.0
    per_interview: float = 0.0
    interviews_per_unit: float | Mapping[str, float] | Callable = 1.0
    per_route: float = 0.0
    currency: str = "cost"

    def __post_init__(self):
        for k in ("per_travel", "per_unit", "per_interview", "per_route"):
            if not getattr(self, k) >= 0:
                raise ValueError(f"{k} must not be negative")

    def interviews(self, units: int, names: list | None = None) -> float:
        per = self.interviews_per_unit
        if callable(per):
            return float(np.sum(per(names)))
        if isinstance(per, Mapping):
            return float(sum(per[u] for u in names))
        return float(per) * units

    def cost_of(self, travel: float, units: int, names: list | None = None, routes: int = 1) -> dict[str, float]:
        """Cost of some travel, visits and routes, by kind."""
        out = {"travel": self.per_travel * travel, "routes": self.per_route * routes, "units": self.per_unit * units, "interviews": self.per_interview * self.interviews(units, names)}
        return out | {"total": sum(out.values())}

    def columns(self, travel: Column, units: Column, routes: Column) -> list[Column]:
        """The same as expressions, for a fixed number of interviews per unit."""
        if callable(self.interviews_per_unit) or isinstance(self.interviews_per_unit, Mapping):
            raise ValueError("expressions need a fixed number of interviews per unit")
        parts = {"travel": travel * self.per_travel, "routes": routes * self.per_route, "units": units * self.per_unit, "interviews": units * self.interviews_per_unit * self.per_interview}
        total = parts["travel"] + parts["routes"] + parts["units"] + parts["interviews"]
        return [c.cast("double").alias(f"cost_{k}") for k, c in {**parts, "total": total}.items()]
