"""Driver-side mathematics: quantiles, rounding, least squares, monotone interpolation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np


def largest_remainder(x: Sequence[float], total: int | None = None, least: int = 1) -> list[int]:
    """Whole numbers near ``x`` that sum to ``total`` (the rounded sum by default), none below ``least``; what the floors
    leave goes to the largest remainders, the first of equals first, and an excess from the floor is taken from the
    largest numbers."""
    x = [float(v) for v in x]
    total = round(sum(x)) if total is None else total
    if total < least * len(x):
        raise ValueError(f"{total} cannot give {least} to each of {len(x)}")
    out = [max(least, math.floor(v)) for v in x]
    rest = [v - math.floor(v) if math.floor(v) >= least else -1.0 for v in x]
    for i in sorted(range(len(x)), key=lambda i: (-rest[i], i))[: max(0, total - sum(out))]:
        out[i] += 1
    while sum(out) < total:
        i = max(range(len(x)), key=lambda i: (x[i] - out[i], -i))
        out[i] += 1
    while sum(out) > total:
        i = max((i for i in range(len(x)) if out[i] > least), key=lambda i: (out[i] - x[i], out[i], -i))
        out[i] -= 1
    return out


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _beta_tail(t: float, df: float) -> float:
    """Probability that Student's t with ``df`` degrees exceeds t >= 0, by a continued fraction."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(a: float, b: float, x: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 400):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + num / (c if abs(c) > tiny else tiny)
                h *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return h

    if x < (a + 1) / (a + b + 2):
        return 0.5 * front * fraction(a, b, x) / a
    return 0.5 * (1 - front * fraction(b, a, 1 - x) / b)


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    if p == 0.5:
        return 0.0
    if math.isinf(df):
        return normal_quantile(p)
    lo, hi = 0.0, 1.0
    while _beta_tail(hi, df) > 1 - p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _beta_tail(mid, df) > 1 - p else (lo, mid)
    return (lo + hi) / 2


def bisect(f, lo: float, hi: float, steps: int = 200) -> float:
    """A root of a function that changes sign between ``lo`` and ``hi``."""
    a = f(lo)
    for _ in range(steps):
        mid = (lo + hi) / 2
        if (f(mid) > 0) == (a > 0):
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


class MonotoneSpline:
    """Piecewise cubic through increasing x that keeps the data's monotonicity (Fritsch and Carlson 1980)."""

    def __init__(self, x: Sequence[float], y: Sequence[float]):
        self.x, self.y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
        h, slope = np.diff(self.x), np.diff(self.y) / np.diff(self.x)
        m = np.concatenate([[slope[0]], (slope[:-1] + slope[1:]) / 2, [slope[-1]]])
        for i, s in enumerate(slope):
            if s == 0:
                m[i] = m[i + 1] = 0
                continue
            a, b = m[i] / s, m[i + 1] / s
            if (r := a * a + b * b) > 9:
                m[i], m[i + 1] = 3 * a * s / math.sqrt(r), 3 * b * s / math.sqrt(r)
        self.h, self.m = h, m

    def __call__(self, v: float) -> float:
        i = int(np.clip(np.searchsorted(self.x, v) - 1, 0, len(self.h) - 1))
        h, t = self.h[i], (v - self.x[i]) / self.h[i]
        if v < self.x[0] or v > self.x[-1]:  # straight on
            e = 0 if v < self.x[0] else -1
            return float(self.y[e] + self.m[e] * (v - self.x[e]))
        return float((1 + 2 * t) * (1 - t) ** 2 * self.y[i] + t * (1 - t) ** 2 * h * self.m[i] + t * t * (3 - 2 * t) * self.y[i + 1] + t * t * (t - 1) * h * self.m[i + 1])


def signif(x: float, digits: int = 4) -> float:
    return 0.0 if x == 0 or not math.isfinite(x) else round(x, digits - 1 - math.floor(math.log10(abs(x))))
