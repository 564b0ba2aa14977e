"""Cost-optimal sample sizes. Inputs are a few rows per stratum or domain; all of this runs on the driver."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasample.functions.checks import exactly_one, requires


@dataclass(frozen=True)
class Allocation:
    """Sizes by stratum with what they cost and attain."""

    strata: list[str]
    n: list[int]
    size: list[float]
    sd: list[float]
    unit_cost: list[float]
    cost: float
    variance: float
    bounded: bool

    def tidy(self, spark: SparkSession) -> DataFrame:
        rows = [(s, z, sd, c, n, n * c, z * z * sd * sd / n * (1 - n / z)) for s, z, sd, c, n in zip(self.strata, self.size, self.sd, self.unit_cost, self.n, strict=True)]
        return spark.createDataFrame(rows, "stratum string, size double, sd double, cost double, n long, cost_total double, variance double")

    def glance(self) -> dict:
        return {"strata": len(self.n), "n": sum(self.n), "cost": self.cost, "variance": self.variance, "bounded": self.bounded}


def strata_table(frame: DataFrame, stratum: str, y: str, cost: Mapping[str, float] | float) -> list[dict]:
    """Stratum sizes and standard deviations of a frame, with unit costs."""
    rows = frame.groupBy(F.col(stratum).cast("string").alias("stratum")).agg(F.count(F.lit(1)).alias("size"), F.stddev_samp(y).alias("sd")).orderBy("stratum").collect()
    price = cost if isinstance(cost, Mapping) else {r["stratum"]: cost for r in rows}
    return [{"stratum": r["stratum"], "size": r["size"], "sd": r["sd"], "cost": price[r["stratum"]]} for r in rows]


def _table(strata) -> list[dict]:
    if isinstance(strata, DataFrame):
        requires(strata, ["size", "sd", "cost"], "strata")
        strata = [r.asDict() for r in strata.collect()]
    return [{"stratum": s.get("stratum", str(i)), **s} for i, s in enumerate(strata, 1)]


def _total_variance(big: np.ndarray, sd: np.ndarray, n: np.ndarray) -> float:
    return float((big**2 * sd**2 / n * (1 - n / big)).sum())


def frame_allocation(strata, target_variance: float | None = None, budget: float | None = None) -> Allocation:
    """Least cost for a variance of the total, or least variance for a budget; sizes between 2 and the stratum's.

    A target's sizes are rounded up; sizes that hit a limit are set and the others solved again. A budget's are rounded
    down and what is left goes, one by one, where it lowers the variance most for its cost.
    """
    exactly_one(target_variance=target_variance, budget=budget)
    rows = _table(strata)
    big, sd, c = (np.array([float(r[k]) for r in rows]) for k in ("size", "sd", "cost"))
    if (big < 2).any() or (sd < 0).any() or (c <= 0).any():
        raise ValueError("strata need at least 2 units, sd not negative and a positive cost")
    low, high = np.full(len(big), 2.0), big
    fixed, n = np.full(len(big), np.nan), None
    for _ in range(2 * len(big) + 2):
        free = np.isnan(fixed)
        if not free.any():
            n = fixed.copy()
            break
        b, s, k = big[free], sd[free], c[free]
        if target_variance is not None:
            set_at = ~free
            spent = _total_variance(big[set_at], sd[set_at], fixed[set_at]) if set_at.any() else 0.0
            room = target_variance - spent + (b * s**2).sum()
            raw = ((b * s * np.sqrt(k)).sum() / room) * b * s / np.sqrt(k) if room > 0 else b
        else:
            left = budget - (c * np.nan_to_num(fixed)).sum()
            share = b * s / np.sqrt(k)
            raw = left * share / (b * s * np.sqrt(k)).sum() if (b * s).any() else np.full(len(b), 2.0)
        n = fixed.copy()
        n[free] = raw
        under, over = free & (n < low), free & (n > high)
        if not under.any() and not over.any():
            break
        fixed[over if over.any() else under] = (high if over.any() else low)[over if over.any() else under]
    bounded = bool((~np.isnan(fixed)).any())
    if target_variance is not None:
        n = np.clip(np.ceil(n - 1e-9), low, high)
    else:
        if (low * c).sum() > budget:
            raise ValueError("the budget does not pay for 2 units in every stratum")
        n = np.clip(np.floor(n + 1e-9), low, high)
        while (n * c).sum() > budget + 1e-9:
            loss = np.where(n > low, big**2 * sd**2 * (1 / (n - 1 + (n <= low)) - 1 / n) / c, np.inf)
            n[int(loss.argmin())] -= 1
        while True:
            can = (n + 1 <= high) & ((n * c).sum() + c <= budget + 1e-9)
            if not can.any():
                break
            gain = np.where(can, big**2 * sd**2 * (1 / n - 1 / (n + 1)) / c, -np.inf)
            n[int(gain.argmax())] += 1
    return Allocation([r["stratum"] for r in rows], [int(v) for v in n], big.tolist(), sd.tolist(), c.tolist(), float((n * c).sum()), _total_variance(big, sd, n), bounded)


@dataclass(frozen=True)
class MultiAllocation:
    """Sizes by stratum that meet a target for every variable."""

    strata: list[str]
    n: list[int]
    unit_cost: list[float]
    variables: list[str]
    target: list[float]
    attained: list[float]
    multipliers: list[float]
    cost: float

    def tidy(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s, c, n, n * c) for s, c, n in zip(self.strata, self.unit_cost, self.n, strict=True)], "stratum string, cost double, n long, cost_total double")

    def glance(self, spark: SparkSession) -> DataFrame:
        """A row per variable."""
        rows = list(zip(self.variables, self.target, self.attained, self.multipliers, strict=True))
        return spark.createDataFrame([(v, t, a, m, sum(self.n), self.cost) for v, t, a, m in rows], "variable string, target double, attained double, multiplier double, n long, cost double")


def multivariate_allocation(strata, sd: Sequence[str], target_variance: Sequence[float] | None = None, target_cv: Sequence[float] | None = None, totals: Sequence[float] | None = None) -> MultiAllocation:
    """Least cost such that every variable's variance meets its target (Bethel's problem, Chromy's iteration)."""
    exactly_one(target_variance=target_variance, target_cv=target_cv)
    rows = _table([{**s, "sd": 0.0} for s in ([r.asDict() for r in strata.collect()] if isinstance(strata, DataFrame) else strata)])
    if target_cv is not None:
        if totals is None:
            raise ValueError("target_cv needs totals")
        target_variance = [(cv * t) ** 2 for cv, t in zip(target_cv, totals, strict=True)]
    big, c = np.array([float(r["size"]) for r in rows]), np.array([float(r["cost"]) for r in rows])
    s2 = np.array([[float(r[k]) ** 2 for k in sd] for r in rows])
    a = big[:, None] ** 2 * s2
    room = np.asarray(target_variance, dtype=float) + (big[:, None] * s2).sum(0)
    weight = np.full(len(sd), 1 / len(sd))
    scale = 1.0
    for _ in range(20_000):
        w = np.sqrt((a @ weight) / c)
        scale = float(((a / w[:, None]).sum(0) / room).max())
        used = (a / (w * scale)[:, None]).sum(0) / room
        new = weight * used**2
        new /= new.sum()
        if np.abs(new - weight).max() < 1e-14:
            weight = new
            break
        weight = new
    w = np.sqrt((a @ weight) / c)
    scale = float(((a / w[:, None]).sum(0) / room).max())
    n = np.clip(np.ceil(w * scale - 1e-9), np.minimum(2, big), big)
    attained = (a / n[:, None]).sum(0) - (big[:, None] * s2).sum(0)
    multipliers = weight * scale**2
    multipliers[multipliers < 1e-12 * multipliers.max()] = 0.0
    return MultiAllocation([r["stratum"] for r in rows], [int(v) for v in n], c.tolist(), list(sd), list(map(float, target_variance)), attained.tolist(), multipliers.tolist(), float((n * c).sum()))


@dataclass(frozen=True)
class DualFrameAllocation:
    n_a: int
    n_b: int
    theta: float
    variance: float
    cost: float
    total: float
    overlap_a: float
    overlap_b: float
    inputs: dict = field(default_factory=dict)

    @property
    def cv(self) -> float:
        return math.sqrt(self.variance) / abs(self.total) if self.total else math.nan

    def tidy(self, spark: SparkSession) -> DataFrame:
        i = self.inputs
        rows = [("a", i["size_a"], self.n_a, i["cost_a"], self.n_a * i["cost_a"], self.overlap_a), ("b", i["size_b"], self.n_b, i["cost_b"], self.n_b * i["cost_b"], self.overlap_b)]
        return spark.createDataFrame([(f, float(z), n, float(c), float(t), float(o)) for f, z, n, c, t, o in rows], "frame string, size double, n long, cost double, cost_total double, overlap double")

    def glance(self) -> dict:
        return {"n_a": self.n_a, "n_b": self.n_b, "theta": self.theta, "variance": self.variance, "cv": self.cv, "cost": self.cost}


def dual_frame_spread(d: Mapping[str, Mapping[str, float]], theta, frame: str):
    """Variance of one frame's values when the overlap counts theta (frame a) or 1 - theta (frame b)."""
    own, t = d[frame], theta if frame == "a" else 1 - theta
    both = d["ab"]
    n = own["size"] + both["size"]
    mean = (own["size"] * own["mean"] + both["size"] * t * both["mean"]) / n
    inside = (own["size"] - 1) * own["sd"] ** 2 + (both["size"] - 1) * t**2 * both["sd"] ** 2
    return (inside + own["size"] * (own["mean"] - mean) ** 2 + both["size"] * (t * both["mean"] - mean) ** 2) / (n - 1)


def dual_frame_allocation(
    domains, cost_a: float, cost_b: float, deff_a: float = 1.0, deff_b: float = 1.0, theta: float | None = None,
    target_variance: float | None = None, target_cv: float | None = None, budget: float | None = None,
) -> DualFrameAllocation:
    """Sizes of two overlapping frames and the weight theta of frame a in the overlap, over thetas 0, .001, ..., 1: least
    cost for a target, least variance for a budget, ties by the other."""
    kind = exactly_one(target_variance=target_variance, target_cv=target_cv, budget=budget)
    rows = [r.asDict() for r in domains.collect()] if isinstance(domains, DataFrame) else list(domains)
    d = {r["domain"]: {k: float(r[k]) for k in ("size", "mean", "sd")} for r in rows}
    if sorted(d) != ["a", "ab", "b"] or len(rows) != 3:
        raise ValueError("domains must be exactly a, ab and b")
    if theta is not None and not 0 <= theta <= 1:
        raise ValueError("theta must lie between 0 and 1")
    big = {f: d[f]["size"] + d["ab"]["size"] for f in "ab"}
    total = sum(v["size"] * v["mean"] for v in d.values())
    target = (target_cv * total) ** 2 if kind == "target_cv" else target_variance
    cost, deff = {"a": cost_a, "b": cost_b}, {"a": deff_a, "b": deff_b}
    if kind == "budget" and budget < 2 * (cost_a + cost_b):
        raise ValueError("the budget does not pay for 2 units in each frame")
    best = None
    for t in [theta] if theta is not None else np.arange(1001) / 1000:
        s2 = {f: deff[f] * dual_frame_spread(d, t, f) for f in "ab"}

        def variance(na: float, nb: float, s2=s2) -> float:
            return sum(big[f] ** 2 * s2[f] / n * (1 - n / big[f]) for f, n in (("a", na), ("b", nb)))

        w = {f: big[f] * math.sqrt(max(0.0, s2[f]) / cost[f]) for f in "ab"}
        if kind == "budget":
            spend = sum(w[f] * cost[f] for f in "ab")
            options = set()
            base = budget * w["a"] / spend if spend else 2
            for na in {math.floor(base), math.ceil(base)}:
                na = int(min(max(na, 2), big["a"], (budget - 2 * cost_b) // cost_a))
                nb = int(min(max((budget - na * cost_a) // cost_b, 2), big["b"]))
                options.add((na, nb))
            nb = int(min(max(math.floor(budget * w["b"] / spend) if spend else 2, 2), big["b"]))
            na = int(min(max((budget - nb * cost_b) // cost_a, 2), big["a"]))
            options.add((na, nb))
            found = [(variance(*o), o[0] * cost_a + o[1] * cost_b, *o, t) for o in options if o[0] * cost_a + o[1] * cost_b <= budget + 1e-9]
        else:
            room = target + sum(big[f] * s2[f] for f in "ab")
            k = sum(big[f] * math.sqrt(s2[f] * cost[f]) for f in "ab") / room
            n = {f: min(max(math.ceil(k * w[f] - 1e-9), 2), int(big[f])) for f in "ab"}
            for f, g in (("a", "b"), ("b", "a")):  # a size at its limit: the other takes up the rest
                if variance(n["a"], n["b"]) > target * (1 + 1e-12):
                    left = target - big[f] ** 2 * s2[f] / n[f] * (1 - n[f] / big[f]) + big[g] * s2[g]
                    n[g] = min(max(math.ceil(big[g] ** 2 * s2[g] / left - 1e-9), 2), int(big[g])) if left > 0 else int(big[g])
            v = variance(n["a"], n["b"])
            found = [(n["a"] * cost_a + n["b"] * cost_b, v, n["a"], n["b"], t)] if v <= target * (1 + 1e-9) else []
        for f in found:
            if best is None or f[:2] < (best[0] - 1e-9 * abs(best[0]), best[1]) or (abs(f[0] - best[0]) <= 1e-9 * abs(best[0]) and f[1] < best[1]):
                best = f
    if best is None:
        raise ValueError("the target cannot be reached")
    first, second, na, nb, t = best
    variance, price = (first, second) if kind == "budget" else (second, first)
    both = d["ab"]["size"]
    inputs = {"cost_a": cost_a, "cost_b": cost_b, "size_a": big["a"], "size_b": big["b"], "domains": d}
    return DualFrameAllocation(int(na), int(nb), float(t), variance, price, total, na * both / big["a"], nb * both / big["b"], inputs)


@dataclass(frozen=True)
class TwoStageAllocation:
    n: int
    m: int
    m_optimal: float
    cost: float
    variance: float
    inputs: dict = field(default_factory=dict)

    def tidy(self, spark: SparkSession) -> DataFrame:
        i = self.inputs
        rows = [("primary", self.n, i["c1"], self.n * i["c1"]), ("secondary", self.n * self.m, i["c2"], self.n * self.m * i["c2"])]
        return spark.createDataFrame([(s, n, float(c), float(t)) for s, n, c, t in rows], "stage string, n long, cost double, cost_total double")

    def glance(self) -> dict:
        return {"n": self.n, "m": self.m, "m_optimal": self.m_optimal, "cost": self.cost, "variance": self.variance}


def two_stage_variance(n: float, m: float, n_primary: float, m_secondary: float, s2_between: float, s2_within: float) -> float:
    """Variance of the mean."""
    return (1 - n / n_primary) * s2_between / n + max(0.0, 1 - m / m_secondary) * s2_within / (n * m)


def two_stage_allocation(
    n_primary: int, m_secondary: float, s2_between: float, s2_within: float, c1: float, c2: float,
    target_variance: float | None = None, target_cv: float | None = None, budget: float | None = None, mean: float | None = None,
) -> TwoStageAllocation:
    """Primary units and secondary units in each: the best of all whole m. Targets are for the total."""
    kind = exactly_one(target_variance=target_variance, target_cv=target_cv, budget=budget)
    scale = (n_primary * m_secondary) ** 2
    if kind == "target_cv":
        if mean is None:
            raise ValueError("target_cv needs the mean")
        target = (target_cv * mean) ** 2
    elif kind == "target_variance":
        target = target_variance / scale
    best = None
    for m in range(1, max(1, math.floor(m_secondary)) + 1):
        if kind == "budget":
            n = min(math.floor(budget / (c1 + c2 * m) + 1e-9), n_primary)
            if n < 2:
                continue
            found = (two_stage_variance(n, m, n_primary, m_secondary, s2_between, s2_within), n * (c1 + c2 * m), n, m)
        else:
            w = max(0.0, 1 - m / m_secondary) * s2_within / m
            n = max(2, math.ceil((s2_between + w) / (target + s2_between / n_primary) - 1e-9))
            if n > n_primary:
                continue
            found = (n * (c1 + c2 * m), two_stage_variance(n, m, n_primary, m_secondary, s2_between, s2_within), n, m)
        if best is None or found < best:
            best = found
    if best is None:
        raise ValueError("the budget or target cannot be met with at least 2 primary units")
    first, second, n, m = best
    variance, cost = (first, second) if kind == "budget" else (second, first)
    spread = s2_between - s2_within / m_secondary
    m_opt = math.sqrt(c1 * s2_within / (c2 * spread)) if spread > 0 and c2 > 0 else float(m_secondary)
    return TwoStageAllocation(n, m, m_opt, cost, variance * scale, {"c1": c1, "c2": c2, "n_primary": n_primary, "m_secondary": m_secondary})
