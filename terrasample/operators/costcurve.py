"""The cost of routed samples as a function of their size."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CostCurve:
    """G(n) = c0 + a n + b sqrt(n), with a and b not negative."""

    c0: float
    a: float
    b: float
    r_squared: float
    points: list[tuple[float, float]]
    currency: str = "cost"
    options: dict = field(default_factory=dict)

    def total(self, n: float) -> float:
        return self.c0 + self.a * n + self.b * math.sqrt(n)

    def average(self, n: float) -> float:
        return self.total(n) / n

    def marginal(self, n: float) -> float:
        return self.a + self.b / (2 * math.sqrt(n))

    def predict(self, n: Sequence[float], kind: str = "total") -> list[float]:
        f: dict[str, Callable[[float], float]] = {"total": self.total, "average": self.average, "marginal": self.marginal}
        if kind not in f:
            raise ValueError("type must be total, average or marginal")
        return [f[kind](float(v)) for v in n]

    def columns(self, n: Column) -> list[Column]:
        """``fitted, average, marginal`` as expressions of a size column."""
        total = F.lit(self.c0) + F.lit(self.a) * n + F.lit(self.b) * F.sqrt(n)
        return [total.alias("fitted"), (total / n).alias("average"), (F.lit(self.a) + F.lit(self.b) / (2 * F.sqrt(n))).alias("marginal")]

    def tidy(self, spark: SparkSession) -> DataFrame:
        rows = spark.createDataFrame([(float(n), float(c)) for n, c in self.points], "n double, cost_mean double")
        return rows.select("n", "cost_mean", *self.columns(F.col("n")))

    def glance(self) -> dict:
        sizes = [p[0] for p in self.points]
        out = {"c0": self.c0, "a": self.a, "b": self.b, "r_squared": self.r_squared, "n_min": min(sizes, default=None), "n_max": max(sizes, default=None), "n_sizes": len(sizes)}
        return out | {"n_rep": self.options.get("n_rep"), "currency": self.currency}

    def __repr__(self) -> str:
        return f"<cost curve {self.c0:.4g} + {self.a:.4g} n + {self.b:.4g} sqrt(n) {self.currency}, R2 {self.r_squared:.3f} over {len(self.points)} sizes>"


def fit_cost_curve(points: Sequence[tuple[float, float]], currency: str = "cost", options: dict | None = None) -> CostCurve:
    """Least squares over the terms 1, n and sqrt(n). Slopes may not be negative: a term that comes out so is left out, the
    root first. Two sizes give a line, one a line through the origin."""
    n, cost = (np.array([float(p[i]) for p in points]) for i in (0, 1))
    sizes = len(set(n.tolist()))

    def least_squares(*use: str) -> dict[str, float]:
        terms = {"c0": np.ones(len(n)), "a": n, "b": np.sqrt(n)}
        found = np.linalg.lstsq(np.column_stack([terms[k] for k in use]), cost, rcond=None)[0]
        return {"c0": 0.0, "a": 0.0, "b": 0.0} | {k: float(v) for k, v in zip(use, found, strict=True)}

    if sizes == 1:
        fit = least_squares("a")
    else:
        fit = least_squares("c0", "a", "b") if sizes > 2 else least_squares("c0", "a")
        if fit["b"] < 0:
            fit = least_squares("c0", "a")
        if fit["a"] < 0:
            fit = least_squares("c0", "b") if sizes > 2 else least_squares("c0")
        if fit["b"] < 0:
            fit = least_squares("c0")
    off = cost - (fit["c0"] + fit["a"] * n + fit["b"] * np.sqrt(n))
    spread = float(((cost - cost.mean()) ** 2).sum())
    r_squared = 1 - float((off**2).sum()) / spread if spread > 0 else 1.0
    return CostCurve(fit["c0"], fit["a"], fit["b"], r_squared, list(zip(n.tolist(), cost.tolist(), strict=True)), currency, options or {})
