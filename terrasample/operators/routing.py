"""Routes of field teams."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrasample.operators.solver import Infeasible, Problem, Solution, solve
from terrasample.operators.travel import CostModel, TravelMatrix

#: Solvers by name; others can be registered. Each takes a Problem and the keyword arguments of ``solve``.
ENGINES = {"builtin": solve}


@dataclass
class Routes:
    """A plan: ``stops`` (route, stop, unit) with route summaries."""

    stops: list[tuple[int, int, str]]
    depots: list[str]
    lengths: list[float]
    durations: list[float]
    loads: list[float]
    total: float
    lower_bound: float
    optimal: bool
    units: list[str]
    travel_unit: str
    best_iteration: int = 0
    cost: dict[str, float] | None = None
    coords: DataFrame | None = None
    method: str = ""
    options: dict = field(default_factory=dict)

    @property
    def gap(self) -> float | None:
        return (self.total - self.lower_bound) / self.lower_bound if self.lower_bound > 0 else None

    @property
    def n_routes(self) -> int:
        return len(self.lengths)

    def glance(self) -> dict:
        out = {"n_units": len(self.units), "n_routes": self.n_routes, "total": self.total, "lower_bound": self.lower_bound, "gap": self.gap, "optimal": self.optimal}
        out |= {"longest_route": max(self.durations, default=0.0), "travel_unit": self.travel_unit}
        return out | ({"cost": self.cost["total"]} if self.cost else {})

    def stops_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r, s, u, self.depots[r - 1]) for r, s, u in self.stops], "route int, stop int, unit string, depot string")

    def __repr__(self) -> str:
        return f"<{self.n_routes} routes over {len(self.units)} units, {self.total:.4g} {self.travel_unit}{', optimal' if self.optimal else ''}>"


def service_vector(value, names: list[str], what: str) -> np.ndarray:
    """A number for all, numbers by name (0 for the rest), or one for each name."""
    if isinstance(value, Mapping):
        unknown = [k for k in value if k not in names]
        if unknown:
            raise ValueError(f"{what} names unknown units: {', '.join(map(str, unknown))}")
        out = np.array([float(value.get(u, 0.0)) for u in names])
    elif np.ndim(value):
        if len(value) != len(names):
            raise ValueError(f"{what} must have one value for each unit")
        out = np.asarray(value, dtype=float)
    else:
        out = np.full(len(names), float(value))
    if not np.isfinite(out).all() or (out < 0).any():
        raise ValueError(f"{what} must not be missing or negative")
    return out


def _names(matrix: TravelMatrix | np.ndarray, units, depots: list) -> tuple[np.ndarray, list[str]]:
    if isinstance(matrix, tuple):
        square, names = matrix
        return np.asarray(square, dtype=float), list(names)
    names = [*depots, *units]
    return matrix.square(names), names


def route_fieldwork(
    matrix,
    units: list,
    depot: str,
    max_length: float = math.inf,
    max_stops: float = math.inf,
    service_time=0,
    demand=0,
    capacity: float = math.inf,
    iterations: int = 200,
    time_limit: float | None = None,
    certify: float = 1.0,
    seed: int = 1,
    cost_model: CostModel | None = None,
    engine: str = "builtin",
) -> Routes:
    """Routes from ``depot`` through all ``units`` with least travel, each within the limits. ``matrix`` is a TravelMatrix or
    a (square, names) pair; units may be names or, for a pair, indices from 1."""
    if isinstance(matrix, tuple) and units and isinstance(units[0], (int, np.integer)) and units[0] not in matrix[1]:
        units = [matrix[1][int(i) - 1] for i in units]
    units = list(units)
    if len(set(units)) != len(units):
        raise ValueError("units must be distinct")
    if depot in units:
        raise ValueError("the depot must not be among the units")
    d, names = _names(matrix, units, [depot])
    missing = [u for u in [depot, *units] if u not in names]
    if missing:
        raise ValueError(f"no travel for {', '.join(map(str, missing))}")
    if np.isnan(d).any() or (d < 0).any():
        raise ValueError("travel must not be missing or negative")
    at = {u: i for i, u in enumerate(names)}
    service = service_vector(service_time, names, "service_time")
    load = service_vector(demand, names, "demand")
    for u in units:
        if load[at[u]] > capacity:
            raise Infeasible(f"unit {u} demands more than a route's capacity")
        trip = d[at[depot], at[u]] + d[at[u], at[depot]] + service[at[u]]
        if trip > max_length * (1 + 1e-12):
            raise Infeasible(f"unit {u} cannot be visited within max_length")
    per_route = cost_model.per_route / cost_model.per_travel if cost_model and cost_model.per_travel > 0 else 0.0
    problem = Problem(d, [at[depot]], [at[u] for u in units], service, load, max_length, max_stops, capacity, per_route)
    s: Solution = ENGINES[engine](problem, iterations=iterations, time_limit=time_limit, certify=certify, seed=seed)
    stops = [(r, k, names[u]) for r, route in enumerate(s.routes, 1) for k, u in enumerate(route, 1)]
    cost = cost_model.cost_of(s.total, len(units), units, len(s.routes)) if cost_model else None
    unit = matrix.unit if isinstance(matrix, TravelMatrix) else "travel"
    return Routes(stops, [depot] * len(s.routes), s.lengths, s.durations, s.loads, s.total, s.lower_bound, s.optimal, units, unit, s.best_iteration, cost, getattr(matrix, "units", None), getattr(matrix, "method", ""))


def _matrix(travel: TravelMatrix | DataFrame) -> TravelMatrix:
    return travel if isinstance(travel, TravelMatrix) else TravelMatrix(travel, travel, "supplied", "travel")


def legs(stops: DataFrame, travel: TravelMatrix | DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """``route, stop, unit, leg``: travel into each stop, from the depot into the first. Routes are bounded by a day's work,
    so a window per route is small. Where stops of a route share numbers, columns ``ties`` order them."""
    place = W.partitionBy("route").orderBy("stop", *ties)
    rows = stops.withColumn("from", F.coalesce(F.lag("unit").over(place), F.col("depot")))
    return _matrix(travel).between(rows, "from", "unit", "leg").select("route", "stop", "unit", "leg")


def route_summary(stops: DataFrame, travel: TravelMatrix | DataFrame, service: DataFrame | None = None, demand: DataFrame | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """``route, stops, length, duration, load`` of given routes, each closed at its depot. ``ties`` as in ``legs``."""
    place = W.partitionBy("route").orderBy("stop", *ties)
    rows = stops.withColumn("from", F.coalesce(F.lag("unit").over(place), F.col("depot"))).withColumn("last", F.lead("unit").over(place).isNull())
    rows = _matrix(travel).between(rows, "from", "unit", "travel")
    rows = _matrix(travel).between(rows, "unit", "depot", "home")
    for table, name in ((service, "service"), (demand, "demand")):
        rows = rows.join(table.select("unit", F.col(name).alias(f"_{name}")), "unit", "left") if table is not None else rows.withColumn(f"_{name}", F.lit(0.0))
    length = F.sum(F.col("travel") + F.when(F.col("last"), F.col("home")).otherwise(0.0))
    return rows.groupBy("route").agg(
        F.count(F.lit(1)).alias("stops"), length.alias("length"), (length + F.sum(F.coalesce("_service", F.lit(0.0)))).alias("duration"), F.sum(F.coalesce("_demand", F.lit(0.0))).alias("load")
    )


def route_segments(stops: DataFrame, units: DataFrame, coords: tuple[str, str], ties: tuple[str, ...] = ()) -> DataFrame:
    """Plot data: a segment per leg, the way home included. Longitude comes first, so that it is drawn along x. ``ties`` as in
    ``legs``."""
    a, b = (coords[1], coords[0]) if coords == ("lat", "lon") else coords
    place = W.partitionBy("route").orderBy("stop", *ties)
    out = stops.withColumn("_from", F.coalesce(F.lag("unit").over(place), F.col("depot"))).withColumn("_next", F.lead("unit").over(place))
    inward = out.select("route", "stop", F.col("_from").alias("f"), F.col("unit").alias("t"))
    home = out.where("_next is null").select("route", (F.col("stop") + 1).alias("stop"), F.col("unit").alias("f"), F.col("depot").alias("t"))
    p = units.select(F.col("unit").alias("f"), F.col(a).alias("x"), F.col(b).alias("y"))
    q = units.select(F.col("unit").alias("t"), F.col(a).alias("xend"), F.col(b).alias("yend"))
    return inward.unionByName(home).join(p, "f").join(q, "t").select("route", "stop", "x", "y", "xend", "yend")


def route_tasks(spark: SparkSession, tasks: list[dict], solve_one) -> pd.DataFrame:
    """Solve independent tasks on the executors, one per partition; returns (key, value) rows of JSON results."""
    rows = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(tasks)], "i int, task string")

    def run(batches):
        for part in batches:
            yield pd.DataFrame({"i": part["i"], "result": [json.dumps(solve_one(json.loads(t)), default=float) for t in part["task"]]})

    found = rows.repartition(max(1, len(tasks)), "i").mapInPandas(run, "i int, result string").collect()
    return pd.DataFrame([(r["i"], json.loads(r["result"])) for r in sorted(found, key=lambda r: r["i"])], columns=["i", "result"])
