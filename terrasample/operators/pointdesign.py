"""Design effect of point sampling by simulation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasample.functions.checks import requires, whole
from terrasample.operators.draws import many_draws
from terrasample.operators.points import cell_sides
from terrasample.operators.select import ONE, infer_coords, prepared, task_seed
from terrasample.operators.simulate import Replicate, estimated

#: Cells of a frame that is broadcast to the tasks whole. Larger frames are drawn from by one distributed plan.
BROADCAST_UNITS = 200_000


def _drawn_in_tasks(cells: DataFrame, coords, n, size, strata, method, replicates, seeds: dict[tuple[int, int], int]) -> DataFrame:
    """Sampled cells of every simulation from a broadcast frame, as ``draws.many_draws`` gives them."""
    spark, kind = cells.sparkSession, dict(cells.dtypes)["unit"]
    columns = list(dict.fromkeys(["unit", *coords, *[c for c in (size, strata) if c]]))
    shared = spark.sparkContext.broadcast(cells.select(*columns).toPandas().sort_values("unit", ignore_index=True))

    def run(batches):
        units = shared.value
        x = units[coords].to_numpy(float)
        h = units[strata].astype(str).to_numpy() if strata else np.full(len(units), ONE)
        z = units[size].to_numpy(float) if size else None
        for part in batches:
            for r in part["r"].tolist():
                drawn = Replicate(x, h, z, n, method, replicates, seeds[0, r])
                own = drawn.chosen
                yield pd.DataFrame({"r": r, "h": h[own], "unit": units["unit"].to_numpy()[own], "x": list(x[own]), "p": drawn.p[own], "member": list(drawn.member[own])})

    tasks = spark.createDataFrame([(r,) for _, r in seeds], "r int").repartition(min(len(seeds), 64), "r")
    return tasks.mapInPandas(run, f"r int, h string, unit {kind}, x array<double>, p double, member array<boolean>")


def point_design_effect(
    cells: DataFrame, areas: DataFrame, n, points_per_cell: int, cell_size, size: str | None = None, strata: str | None = None, method: str = "lpm", replicates: int = 1,
    n_sim: int = 200, seed: int = 1, coords: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Design effect of point sampling against SRS of as many establishments: each simulation, a task, draws cells and
    points, hits establishments by their share of the cell, and estimates. Returns one row and the simulations. Land stays
    distributed: a task gets that of its own cells only."""
    requires(areas, ["establishment", "unit", "area", "y"], "areas")
    coords = infer_coords(cells, coords)
    seed, n_sim = whole(seed, "seed"), whole(n_sim, "n_sim", 1)
    cell_area = math.prod(cell_sides(cell_size))
    land = areas.select("unit", "establishment", F.col("area").cast("double"), F.col("y").cast("double")).repartition("unit").persist()  # read by the passes below
    rows, p, design = prepared(cells, n, size, coords, strata, method, replicates, 1)
    pi = p if replicates == 1 else 1 - F.pow(1 - p / replicates, replicates)
    used = land.groupBy("unit").agg(F.sum("area").alias("used")).join(rows.select("unit", pi.alias("pi")), "unit", "left")
    bad = used.where((F.col("used") > cell_area + 1e-9) | F.col("pi").isNull()).orderBy(F.col("used") <= cell_area + 1e-9, "unit").first()
    if bad and bad["used"] > cell_area + 1e-9:
        raise ValueError(f"the establishments' land exceeds the cell area in cell {bad['unit']}")
    if bad:
        raise ValueError(f"areas refer to cells that are not in the frame: {bad['unit']}")
    # an establishment's hits expected of any sample, and its first value
    hits = F.sum(F.col("area") * F.col("pi") * (points_per_cell / cell_area))
    made = land.join(rows.select("unit", pi.alias("pi")), "unit").groupBy("establishment").agg(hits.alias("expected"), F.min_by("y", "unit").alias("one_y")).persist()
    seeds = {(0, b): task_seed(seed, b, "cells") for b in range(1, n_sim + 1)}
    if cells.limit(BROADCAST_UNITS + 1).count() <= BROADCAST_UNITS:
        drawn = _drawn_in_tasks(cells, coords, n, size, strata, method, replicates, seeds)
    else:
        drawn = many_draws(cells, coords, [n], {k: s % 2**31 for k, s in seeds.items()}, size, strata, method, replicates)[0]
    drawn = drawn.select("r", "h", "unit", "x", "p", "member")
    hit = drawn.join(land, "unit", "left").join(made, "establishment", "left").drop("y")

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["unit", "establishment"], kind="stable", ignore_index=True)
        b, random = key[0], np.random.default_rng(task_seed(seed, key[0], "points"))
        unit = rows["unit"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        area, worth, names = rows["area"].to_numpy(float), (rows["one_y"] / rows["expected"]).to_numpy(float), rows["establishment"].to_numpy()
        own, found = np.zeros(len(first)), set()
        for i, (begin, end) in enumerate(zip(first, [*first[1:], len(unit)], strict=True)):
            g = slice(begin, end)
            if not np.isnan(area[begin]):
                share = area[g] / cell_area
                hits = random.multinomial(points_per_cell, np.append(share, max(0.0, 1 - share.sum())))[:-1]
                some = hits > 0
                own[i] = (hits[some] * worth[g][some]).sum()
                found.update(names[g][some].tolist())
        cell = rows.iloc[first]
        p = cell["p"].to_numpy(float)
        pi = p if replicates == 1 else 1 - (1 - p / replicates) ** replicates
        x, member = (np.array(cell[c].tolist()) for c in ("x", "member"))
        # a cell's value is already expanded
        variance = estimated(method, design.n, design.sizes, x, cell["h"].to_numpy(), own * pi, pi, p / replicates, member)[1] if found else None
        return pd.DataFrame({"b": [b], "estimate": [float(own.sum())], "variance": [variance], "interviews": [len(found)]})

    sims = hit.repartition(min(n_sim, 64), "r").groupBy("r").applyInPandas(one, "b int, estimate double, variance double, interviews int")
    of = made.agg(F.count(F.lit(1)).alias("k"), F.sum("one_y").alias("t"), F.var_samp("one_y").alias("v")).first()
    everyone, truth, s2 = of["k"], float(of["t"] or 0), float(of["v"] or 0)
    talks, v = F.avg("interviews"), F.var_samp("estimate")
    srs = everyone**2 * (1 - talks / everyone) * s2 / talks
    out = sims.agg(
        F.count(F.lit(1)).alias("n_sim"), F.lit(truth).alias("total"), F.avg("estimate").alias("mean_estimate"), (F.avg("estimate") - truth).alias("bias"), v.alias("variance"),
        (F.sqrt(v) / truth).alias("cv"), F.avg("variance").alias("mean_variance_estimate"), talks.alias("interviews"), srs.alias("variance_srs"), (v / srs).alias("deff"),
    )
    return out, sims
