"""Cost and variance of designs by Monte Carlo: every replicate is a task that draws, routes, prices and estimates."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasample.functions.checks import requires, whole
from terrasample.operators.costcurve import CostCurve, fit_cost_curve
from terrasample.operators.draws import many_draws
from terrasample.operators.select import METHODS, infer_coords, task_seed
from terrasample.operators.simulate import Replicate, estimated, travel_between
from terrasample.operators.solver import Problem, solve
from terrasample.operators.travel import CostModel, TravelMatrix

#: Units of a frame that is broadcast to the tasks whole. Larger frames are drawn from by one distributed plan for all
#: replicates, which gives the same designs.
BROADCAST_UNITS = 200_000

_DRAWN = "k int, r int, unit string, a double, b double, estimate double, variance double, allocation map<string,int>"
_PRICED = "k int, r int, n int, cost double, travel double, routes int, interviews double, estimate double, variance double, allocation map<string,int>"


def _draws_in_tasks(frame: DataFrame, coords, n_grid, y, size, strata, selection, replicates, n_rep, seed) -> DataFrame:
    """Sampled units of every (size, replicate) from a broadcast frame, with the replicate's estimate."""
    spark = frame.sparkSession
    columns = list(dict.fromkeys(["unit", *coords, *[c for c in (y, size, strata) if c]]))
    units = frame.select(*columns).toPandas().sort_values("unit", ignore_index=True)
    shared = spark.sparkContext.broadcast(units)
    tasks = spark.createDataFrame([(k, r) for k in range(len(n_grid)) for r in range(1, n_rep + 1)], "k int, r int").repartition(len(n_grid) * n_rep, "k", "r")

    def one(k: int, r: int) -> pd.DataFrame:
        units = shared.value
        x = units[coords].to_numpy(float)
        h = units[strata].astype(str).to_numpy() if strata else np.full(len(units), "all")
        drawn = Replicate(x, h, units[size].to_numpy(float) if size else None, n_grid[k], selection, replicates, task_seed(seed, k, r))
        total, variance = drawn.estimate(units[y].to_numpy(float)) if y else (None, None)
        own = drawn.chosen
        allocation = [(str(s), int(m)) for s, m in drawn.n.items()]
        return pd.DataFrame({"k": k, "r": r, "unit": units["unit"].to_numpy()[own], "a": x[own, 0], "b": x[own, 1], "estimate": total, "variance": variance, "allocation": [dict(allocation)] * len(own)})

    def run(batches):
        for part in batches:
            for k, r in zip(part["k"], part["r"], strict=True):
                yield one(int(k), int(r))

    return tasks.mapInPandas(run, _DRAWN)


def _draws_in_one_plan(frame: DataFrame, coords, n_grid, y, size, strata, selection, replicates, n_rep, seed) -> DataFrame:
    """The same from a frame of any size: all replicates are drawn in one plan, and a task has the sample of one."""
    seeds = {(k, r): task_seed(seed, k, r) % 2**31 for k in range(len(n_grid)) for r in range(1, n_rep + 1)}
    drawn, designs, _ = many_draws(frame, coords, n_grid, seeds, size, strata, selection, replicates, y)

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("unit", ignore_index=True)
        d, x, p = designs[key[0]], np.array(rows["x"].tolist(), dtype=float), rows["p"].to_numpy(float)
        each, pi = p / replicates, p if replicates == 1 else 1 - (1 - p / replicates) ** replicates
        member = np.array(rows["member"].tolist(), dtype=bool)
        total, variance = estimated(selection, d.n, d.sizes, x, rows["h"].to_numpy(), rows["y"].to_numpy(float), pi, each, member) if y else (None, None)
        return pd.DataFrame({"k": key[0], "r": key[1], "unit": rows["unit"], "a": x[:, 0], "b": x[:, 1], "estimate": total, "variance": variance, "allocation": [dict(d.n)] * len(rows)})

    return drawn.repartition(len(seeds), "k", "r").groupBy("k", "r").applyInPandas(one, _DRAWN)  # samples are few bytes and much work


def cost_variance_frontier(
    frame: DataFrame, depot: str, cost_model: CostModel, n_grid: Sequence[int | Mapping[str, int]], y: str | None = None, size: str | None = None, strata: str | None = None,
    selection: str = "lpm", replicates: int = 1, matrix: TravelMatrix | None = None, method: str | None = None, max_length: float = math.inf, max_stops: float = math.inf,
    n_rep: int = 20, iterations: int = 50, seed: int = 1, coords: list[str] | None = None,
) -> DataFrame:
    """One row per sample size (a number, or numbers by stratum): mean and spread of the routed cost, travel, routes and,
    with ``y``, the estimated variance and cv of its total, matched to the design, and the variance between replicates.

    Travel is a straight line (``method``), or a ``matrix`` of all units and the depot, of which each task gets the rows of
    its own sample by a join.
    """
    if not len(n_grid):
        raise ValueError("n_grid must have at least one sample size")
    if selection not in METHODS:
        raise ValueError(f"selection must be one of {', '.join(METHODS)}")
    if replicates > 1 and selection != "systematic":
        raise ValueError("replicates need selection 'systematic'")
    requires(frame, ["unit"], "the frame")
    seed, n_rep = whole(seed, "seed"), whole(n_rep, "n_rep", 1)
    coords = infer_coords(frame, coords)
    requires(frame, [c for c in (y, size, strata) if c], "the frame")
    home = frame.where(F.col("unit") == depot).select(*[F.col(c).cast("double") for c in coords]).limit(1).collect()
    if not home:
        raise ValueError(f"the depot {depot} was not found among the units")
    base = [float(v) for v in home[0]]
    method = method or ("haversine" if coords == ["lat", "lon"] else "euclidean")
    units = frame.where(F.col("unit") != depot).withColumn("unit", F.col("unit").cast("string"))
    grid = [dict(n) if isinstance(n, Mapping) else whole(n, "n", 1) for n in n_grid]
    small = units.limit(BROADCAST_UNITS + 1).count() <= BROADCAST_UNITS
    draws = (_draws_in_tasks if small else _draws_in_one_plan)(units, coords, grid, y, size, strata, selection, replicates, n_rep, seed)

    def priced(key: tuple, rows: pd.DataFrame, travel: np.ndarray) -> pd.DataFrame:
        names, m = rows["unit"].tolist(), len(rows)
        per_route = cost_model.per_route / cost_model.per_travel if cost_model.per_travel > 0 else 0.0
        problem = Problem(travel, [0], list(range(1, m + 1)), np.zeros(m + 1), np.zeros(m + 1), max_length, max_stops, math.inf, per_route)
        plan = solve(problem, iterations, certify=0, seed=task_seed(seed, key[1]) % 2**31)
        cost = cost_model.cost_of(plan.total, m, names, len(plan.routes))
        first = rows.iloc[0]
        return pd.DataFrame({
            "k": [key[0]], "r": [key[1]], "n": [sum(first["allocation"].values())], "cost": [cost["total"]], "travel": [plan.total], "routes": [len(plan.routes)],
            "interviews": [cost_model.interviews(m, names)], "estimate": [first["estimate"]], "variance": [first["variance"]], "allocation": [first["allocation"]],
        })

    if matrix is None:

        def straight(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("unit", ignore_index=True)
            return priced(key, rows, travel_between(np.concatenate([[base], rows[["a", "b"]].to_numpy(float)]), method))

        done = draws.groupBy("k", "r").applyInPandas(straight, _PRICED)
    else:
        stops = draws.select("k", "r", "unit").union(draws.select("k", "r", F.lit(depot)).distinct())
        legs = matrix.df.select(F.col("from").cast("string").alias("f"), F.col("to").cast("string").alias("t"), "travel")
        legs = stops.withColumnRenamed("unit", "f").join(legs, "f").join(stops.withColumnRenamed("unit", "t"), ["k", "r", "t"])
        legs = legs.select(F.col("k").alias("of_k"), F.col("r").alias("of_r"), "f", "t", "travel")

        def given(key: tuple, rows: pd.DataFrame, legs: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("unit", ignore_index=True)
            at = {u: i for i, u in enumerate([depot, *rows["unit"]])}
            travel = np.full((len(at), len(at)), np.nan)
            travel[legs["f"].map(at).to_numpy(), legs["t"].map(at).to_numpy()] = legs["travel"].to_numpy(float)
            np.fill_diagonal(travel, 0.0)
            if np.isnan(travel).any():
                raise ValueError("the matrix must have all units of the frame and the depot")
            return priced(key, rows, travel)

        done = draws.groupBy("k", "r").cogroup(legs.groupBy("of_k", "of_r")).applyInPandas(given, _PRICED)

    cv = F.when(F.col("estimate") != 0, F.sqrt("variance") / F.abs("estimate"))
    out = done.groupBy("k").agg(
        F.max("n").alias("n"), F.avg("cost").alias("cost_mean"), F.stddev_samp("cost").alias("cost_sd"), (F.avg("cost") / F.max("n")).alias("cost_per_unit"), F.avg("travel").alias("travel_mean"),
        F.avg("routes").alias("routes_mean"), F.avg("interviews").alias("interviews_mean"), F.avg("estimate").alias("estimate_mean"), F.var_samp("estimate").alias("variance_mc"),
        F.avg("variance").alias("variance_mean"), F.avg(cv).alias("cv_mean"), F.count(F.lit(1)).alias("n_rep"), F.max_by("allocation", "r").alias("allocation"),
    )
    unknown = [] if y else ["estimate_mean", "variance_mc", "variance_mean", "cv_mean"]
    return out.drop("k", *unknown, *([] if strata else ["allocation"]))


def frontier_glance(frontier: DataFrame) -> DataFrame:
    """One row: sizes, replicates, and the ranges of cost and, where a variable was given, variance."""
    v = F.coalesce("variance_mean", "variance_mc") if "variance_mean" in frontier.columns else F.lit(None).cast("double")
    return frontier.agg(
        F.count(F.lit(1)).alias("sizes"), F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.max("n_rep").alias("n_rep"),
        F.min("cost_mean").alias("cost_min"), F.max("cost_mean").alias("cost_max"), F.min(v).alias("variance_min"), F.max(v).alias("variance_max"),
    )


def routed_unit_cost(frame: DataFrame, depot: str, cost_model: CostModel, n, n_rep: int = 10, **options) -> dict:
    """Mean cost and travel per unit of samples of ``n``."""
    r = cost_variance_frontier(frame, depot, cost_model, [n], n_rep=n_rep, **options).first()
    return {"n": r["n"], "cost_per_unit": r["cost_mean"] / r["n"], "travel_per_unit": r["travel_mean"] / r["n"], "cost_mean": r["cost_mean"], "routes_mean": r["routes_mean"], "n_rep": n_rep}


def routed_cost_curve(frame: DataFrame, depot: str, cost_model: CostModel, n_grid: Sequence[int], n_rep: int = 5, **options) -> CostCurve:
    """Fit the cost of routed samples of at least three sizes."""
    sizes = sorted(set(n_grid))
    if len(sizes) < 3:
        raise ValueError("a cost curve needs at least three sizes")
    rows = cost_variance_frontier(frame, depot, cost_model, sizes, n_rep=n_rep, **options).select("n", "cost_mean").collect()
    return fit_cost_curve(sorted((r["n"], r["cost_mean"]) for r in rows), cost_model.currency, {"n_rep": n_rep, **options})
