"""Summaries of simulation studies."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrasample.functions.numeric import MonotoneSpline, bisect, t_quantile
from terrasample.operators.allocation import multivariate_allocation
from terrasample.functions.numeric import largest_remainder


def mc_design_variance(runs: DataFrame, keys: list[str], design: str = "design", estimate: str = "estimate", reference: str = "srs") -> DataFrame:
    """Monte-Carlo variance by scenario and design, and its ratio to the reference design's."""
    by = runs.groupBy(*keys, design).agg(F.var_samp(estimate).alias("variance"), F.avg(estimate).alias("mean"), F.count(F.lit(1)).alias("runs"))
    base = F.max(F.when(F.col(design) == reference, F.col("variance"))).over(W.partitionBy(*keys))
    return by.withColumn("deff", F.col("variance") / base)


def t_table(df: DataFrame, column: str, level: float = 0.95) -> DataFrame:
    """The t quantiles of the degrees of freedom that occur: few, so computed on the driver."""
    found = [r[0] for r in df.select(column).distinct().collect() if r[0] is not None]
    return df.sparkSession.createDataFrame([(int(d), float(t_quantile(0.5 + level / 2, d))) for d in found], f"{column} long, t double")


def coverage_table(runs: DataFrame, keys: list[str], truth: str = "truth", level: float = 0.95) -> DataFrame:
    """Relative bias of the variance estimator, and how often the t interval covers the truth."""
    rows = runs.join(F.broadcast(t_table(runs, "df", level)), "df")
    covered = (F.abs(F.col("total") - F.col(truth)) <= F.col("t") * F.col("se")).cast("double")
    return rows.groupBy(*keys).agg(
        (F.avg("variance") / F.var_samp("total") - 1).alias("relative_bias"), F.avg(covered).alias("coverage"), (F.avg("total") / F.avg(truth) - 1).alias("bias"), F.count(F.lit(1)).alias("runs")
    )


def interpolate(points: DataFrame, curve: DataFrame, keys: list[str], x: str, y: str, name: str, log: bool = False) -> DataFrame:
    """``points`` with the curve's value at ``x`` added: linear between the curve's neighbours (in logs if ``log``).

    A curve is its brackets, made by ``lead``; a point falls into one, so this is a join on the keys and a range. Curves
    have a few points each.
    """
    place = W.partitionBy(*keys).orderBy(x)
    f = (lambda c: F.log(c)) if log else (lambda c: c)
    seg = curve.select(*keys, F.col(x).alias("_x0"), F.col(y).alias("_y0"), F.lead(x).over(place).alias("_x1"), F.lead(y).over(place).alias("_y1"), F.lag(x).over(place).isNull().alias("_first"))
    seg = seg.where("_x1 is not null")
    within = ((F.col(x) > F.col("_x0")) | (F.col("_first") & (F.col(x) == F.col("_x0")))) & (F.col(x) <= F.col("_x1"))
    joined = points.join(seg.withColumnsRenamed({k: f"_k_{k}" for k in keys}), [F.col(k) == F.col(f"_k_{k}") for k in keys] + [within], "left")
    w = (f(F.col(x)) - f(F.col("_x0"))) / (f(F.col("_x1")) - f(F.col("_x0")))
    value = f(F.col("_y0")) + w * (f(F.col("_y1")) - f(F.col("_y0")))
    return joined.withColumn(name, F.exp(value) if log else value).drop("_x0", "_y0", "_x1", "_y1", "_first", *[f"_k_{k}" for k in keys])


def travel_ratio(curves: DataFrame, keys: list[str], design: str = "design", reference: str = "srs", x: str = "n", y: str = "travel") -> DataFrame:
    """Each design's travel against the reference's at the same size, interpolated."""
    base = curves.where(F.col(design) == reference)
    out = interpolate(curves.where(F.col(design) != reference), base, keys, x, y, "reference")
    return out.withColumn("ratio", F.col(y) / F.col("reference"))


def equal_budget_size(points: Sequence[tuple[float, float]], budget: float, per_unit: float = 0.0) -> float:
    """The size at which a monotone spline of cost, plus a cost per unit, uses up a budget."""
    spline = MonotoneSpline(*zip(*sorted(points), strict=True))
    return bisect(lambda n: spline(n) + per_unit * n - budget, min(p[0] for p in points), max(p[0] for p in points))


def equal_budget_efficiency(variances: DataFrame, sizes: DataFrame, keys: list[str], design: str = "design", reference: str = "srs") -> DataFrame:
    """Variance at the size that a budget affords (log-log interpolation) against the reference design's."""
    at = interpolate(sizes, variances, [*keys, design], "n", "variance", "affordable_variance", log=True)
    base = F.max(F.when(F.col(design) == reference, F.col("affordable_variance"))).over(W.partitionBy(*keys))
    return at.withColumn("efficiency", F.col("affordable_variance") / base)


def travel_law(curves: DataFrame, keys: list[str], x: str = "n", y: str = "travel", area: float = 1.0) -> DataFrame:
    """Exponent of travel in size (log-log slope) and the constant of length = beta sqrt(n area)."""
    z = F.sqrt(F.col(x) * area)
    return curves.groupBy(*keys).agg(F.regr_slope(F.log(y), F.log(x)).alias("exponent"), (F.sum(F.col(y) * z) / F.sum(z * z)).alias("beta"))


def skewness(column: Column | str) -> Column:
    """Third central moment over the cubed sample standard deviation."""
    c = F.col(column) if isinstance(column, str) else column
    n, m = F.count(c), F.avg(c)
    third = F.avg(c * c * c) - 3 * m * F.avg(c * c) + 2 * m * m * m
    return F.when(n > 1, third / F.pow(F.stddev_samp(c), 3))


def size_band(n: Column) -> Column:
    return F.when(n <= 40, "n <= 40").when(n <= 80, "40 < n <= 80").otherwise("n > 80")


def nearest_pairs(rows: DataFrame, k: int, cell: float | None = None) -> DataFrame:
    """``unit, u2, place`` of the k nearest others of each of ``unit, a, b`` rows, by (distance, unit).

    Candidates of a unit are those in its own and the eight neighbouring buckets of side ``cell``. Whatever lies beyond
    them is farther away than the nearest edge of that block, so a unit whose k-th candidate is within that edge is
    settled; the others go on with buckets twice as wide, until their block holds all units. A round joins only units that
    are not settled.
    """
    box = rows.agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1"), F.count(F.lit(1)).alias("n")).first()
    if not box["n"]:
        return rows.select("unit", F.col("unit").alias("u2"), F.lit(0).alias("place"))
    wide, high = box["a1"] - box["a0"], box["b1"] - box["b0"]
    area = wide * high if wide > 0 and high > 0 else max(wide, high) ** 2 / box["n"]
    cell = float(cell or max(math.sqrt(area * (k + 1) / box["n"]), max(wide, high) / 4096, 1e-12))
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    left, done = rows.select("unit", "a", "b"), None
    while True:
        whole = cell >= max(wide, high)
        bucket = lambda c, low, cell=cell: F.floor((F.col(c) - F.lit(float(low))) / cell).cast("long")
        right = rows.select(F.col("unit").alias("u2"), F.col("a").alias("a2"), F.col("b").alias("b2"), bucket("a", box["a0"]).alias("i"), bucket("b", box["b0"]).alias("j"))
        asked = left.withColumn("i0", bucket("a", box["a0"])).withColumn("j0", bucket("b", box["b0"]))
        spread = asked.withColumn("di", F.explode(near)).withColumn("dj", F.explode(near)).withColumn("i", F.col("i0") + F.col("di")).withColumn("j", F.col("j0") + F.col("dj"))
        pairs = spread.join(right, ["i", "j"]).where("unit <> u2")
        d = (F.col("a") - F.col("a2")) * (F.col("a") - F.col("a2")) + (F.col("b") - F.col("b2")) * (F.col("b") - F.col("b2"))
        pairs = pairs.select("unit", "u2", d.alias("d")).withColumn("place", F.row_number().over(W.partitionBy("unit").orderBy("d", "u2"))).where(F.col("place") <= k)
        x, y = F.col("a") - F.lit(float(box["a0"])) - F.col("i0") * cell, F.col("b") - F.lit(float(box["b0"])) - F.col("j0") * cell
        edge = F.least(x, cell - x, y, cell - y) + cell
        far = pairs.where(F.col("place") == k).select(F.col("unit").alias("v"), F.col("d").alias("far"))
        told = asked.join(far, F.col("unit") == F.col("v"), "left").select("unit", "a", "b", (F.lit(whole) | F.coalesce(F.col("far") < edge * edge * (1 - 1e-9), F.lit(False))).alias("settled"))
        told = told.persist()
        good = pairs.join(told.where("settled").select("unit"), "unit", "left_semi").select("unit", "u2", "place")
        done = good if done is None else done.unionByName(good)
        left = told.where(~F.col("settled")).drop("settled")
        if whole or not left.limit(1).count():
            return done
        cell *= 2


def moran_i(frame: DataFrame, value: str, coords: tuple[str, str] = ("x", "y"), k: int = 8, cell: float | None = None) -> DataFrame:
    """Moran's I with the k nearest neighbours of each unit, by (distance, unit); ``n`` is the number of units that have
    any. ``cell`` is only where the search starts, see ``nearest_pairs``."""
    a, b = coords
    rows = frame.select("unit", F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"), F.col(value).cast("double").alias("v"))
    mean = rows.agg(F.avg("v").alias("m"))
    rows = rows.crossJoin(F.broadcast(mean)).withColumn("e", F.col("v") - F.col("m"))
    pairs = nearest_pairs(rows, k, cell)
    lag = pairs.join(rows.select(F.col("unit").alias("u2"), F.col("e").alias("e2")), "u2").groupBy("unit").agg(F.avg("e2").alias("lag"))
    lag = lag.join(rows.select("unit", "e"), "unit")
    return lag.agg((F.sum(F.col("e") * F.col("lag")) / F.sum(F.col("e") * F.col("e"))).alias("moran_i"), F.count(F.lit(1)).alias("n"))


def gaussian_field(coords: np.ndarray, practical_range: float, nugget: float = 0.2, seed: int = 1, fields: int = 1) -> np.ndarray:
    """Gaussian random fields with exponential covariance, by a Cholesky factor."""
    d = np.sqrt(((coords[:, None] - coords) ** 2).sum(-1))
    c = (1 - nugget) * np.exp(-3 * d / practical_range) + nugget * np.eye(len(coords))
    return np.linalg.cholesky(c + 1e-10 * np.eye(len(coords))) @ np.random.default_rng(seed).normal(size=(len(coords), fields))


def two_stage_grid(spark, n_primary: int, m_secondary: float, s2_between: float, s2_within: float, c1: float, c2: float, budget: float) -> DataFrame:
    """All (n, m) that a budget pays for, as a DataFrame: n of each whole m, with cost and variance of the total."""
    m = spark.range(1, int(m_secondary) + 1).select(F.col("id").cast("double").alias("m"))
    n = F.least(F.floor(F.lit(float(budget)) / (F.lit(float(c1)) + F.lit(float(c2)) * F.col("m"))).cast("double"), F.lit(float(n_primary)))
    rows = m.withColumn("n", n).where("n >= 2")
    v = (1 - F.col("n") / n_primary) * s2_between / F.col("n") + F.greatest(F.lit(0.0), 1 - F.col("m") / m_secondary) * s2_within / (F.col("n") * F.col("m"))
    return rows.select("n", "m", (F.col("n") * (c1 + c2 * F.col("m"))).alias("cost"), (v * float(n_primary * m_secondary) ** 2).alias("variance"))


def best_of(grid: DataFrame, *order: str) -> DataFrame:
    """The row that comes first by ``order``: a minimum, not a sort."""
    rest = [c for c in grid.columns if c not in order]
    return grid.agg(F.min(F.struct(*order, *rest)).alias("r")).select("r.*")


def stratify(frame: DataFrame, column: str, cuts: Sequence[float], name: str = "stratum") -> DataFrame:
    """Strata by ascending cut points."""
    rule = F.lit(f"s{len(cuts) + 1}")
    for i in range(len(cuts), 0, -1):
        rule = F.when(F.col(column) <= cuts[i - 1], f"s{i}").otherwise(rule)
    return frame.withColumn(name, rule)


def bethel_shares(frame: DataFrame, stratum: str, variables: Sequence[str], n: int, cv: float = 0.05) -> dict[str, int]:
    """A total n shared over strata as the allocation that meets one cv for all variables would."""
    rows = frame.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"), *[F.stddev_samp(v).alias(v) for v in variables], *[F.sum(v).alias(f"t_{v}") for v in variables]).orderBy(stratum).collect()
    table = [{"stratum": r[stratum], "size": r["size"], "cost": 1.0, **{v: r[v] for v in variables}} for r in rows]
    a = multivariate_allocation(table, list(variables), target_cv=[cv] * len(variables), totals=[sum(r[f"t_{v}"] for r in rows) for v in variables])
    total = sum(a.n)
    return dict(zip(a.strata, largest_remainder([n * k / total for k in a.n], n, 2), strict=True))


def average_cost_loop(start: float, allocate, average, rounds: int = 20, tolerance: float = 1e-6) -> tuple[object, float, int]:
    """Allocate at a unit cost, replace it by the realised average cost of that size, repeat until it settles."""
    cost, found = start, None
    for i in range(1, rounds + 1):
        found = allocate(cost)
        new = average(found)
        if abs(new - cost) <= tolerance * abs(cost):
            return found, new, i
        cost = new
    return found, cost, rounds


def wide(df: DataFrame, keys: Sequence[str], column: str, value: str, levels: Sequence[str]) -> DataFrame:
    """A column for each of the known ``levels``; naming them spares a pass over the data."""
    return df.groupBy(*keys).pivot(column, list(levels)).agg(F.min(value))


def long(df: DataFrame, keys: Sequence[str], values: Sequence[str], column: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(values), column, value)


def scenario_grid(spark, **options: Sequence) -> DataFrame:
    """All combinations of a few options, a row each."""
    from itertools import product

    rows = [tuple(c) for c in product(*options.values())]
    return spark.createDataFrame(rows, list(options))


def efficiency_summary(df: DataFrame, keys: Sequence[str], column: str = "efficiency") -> DataFrame:
    """Best, mean and worst efficiency and the share of scenarios in which it is below 1."""
    c = F.col(column)
    return df.groupBy(*keys).agg(F.min(c).alias("best"), F.avg(c).alias("mean"), F.max(c).alias("worst"), F.avg((c < 1).cast("double")).alias("wins"), F.count(F.lit(1)).alias("scenarios"))


def dual_frame_grid(spark, domains: dict, cost_a: float, cost_b: float, budget: float, sizes_a: int, thetas: int = 101, deff_a: float = 1.0, deff_b: float = 1.0) -> DataFrame:
    """Every (n_a, n_b, theta) that uses up a budget, with its variance: the exhaustive search that an allocation is held against."""
    a, b, ab = (domains[k] for k in ("a", "b", "ab"))
    big_a, big_b = float(a["size"] + ab["size"]), float(b["size"] + ab["size"])
    n = spark.range(2, sizes_a + 1).select(F.col("id").cast("double").alias("n_a"))
    t = spark.range(thetas).select((F.col("id") / F.lit(float(thetas - 1))).alias("theta"))
    rows = n.crossJoin(F.broadcast(t)).withColumn("n_b", F.least(F.floor((F.lit(float(budget)) - cost_a * F.col("n_a")) / cost_b).cast("double"), F.lit(big_b))).where("n_b >= 2")

    def spread(own: dict, w, big: float):
        mean = (own["size"] * own["mean"] + ab["size"] * w * ab["mean"]) / big
        within = (own["size"] - 1) * float(own["sd"]) ** 2 + (ab["size"] - 1) * w * w * float(ab["sd"]) ** 2
        return (within + own["size"] * (own["mean"] - mean) * (own["mean"] - mean) + ab["size"] * (w * ab["mean"] - mean) * (w * ab["mean"] - mean)) / (big - 1)

    v_a = deff_a * big_a * big_a * spread(a, F.col("theta"), big_a) / F.col("n_a") * (1 - F.col("n_a") / big_a)
    v_b = deff_b * big_b * big_b * spread(b, 1 - F.col("theta"), big_b) / F.col("n_b") * (1 - F.col("n_b") / big_b)
    return rows.select("n_a", "n_b", "theta", (cost_a * F.col("n_a") + cost_b * F.col("n_b")).alias("cost"), (v_a + v_b).alias("variance"))
