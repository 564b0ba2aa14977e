"""One replicate of a survey in numpy: a draw of the library's methods and the variance that matches it. No Spark here."""

from __future__ import annotations

import numpy as np

from terrasample.functions.columns import EARTH_KM, HILBERT_BITS
from terrasample.functions.numeric import largest_remainder
from terrasample.operators.spatial import cube, local_pivotal, neighbours


def travel_between(x: np.ndarray, method: str) -> np.ndarray:
    """Straight-line travel between all pairs of rows."""
    if method == "haversine":
        lat, lon = np.radians(x[:, 0]), np.radians(x[:, 1])
        h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat)[:, None] * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
        return 2 * EARTH_KM * np.arcsin(np.minimum(1, np.sqrt(h)))
    return np.sqrt(((x[:, None] - x) ** 2).sum(-1))


def hilbert_place(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Place of points along a Hilbert curve over the box from ``low`` to ``high``, as ``columns.hilbert`` has it."""
    top = (1 << HILBERT_BITS) - 1
    span = np.where(high > low, high - low, 1.0)
    a, b = np.floor((x - low) / span * top).astype(np.int64).T
    out = np.zeros(len(x), dtype=np.int64)
    for bit in range(HILBERT_BITS - 1, -1, -1):
        side = 1 << bit
        right, up = (a & side) > 0, (b & side) > 0
        out += side * side * ((3 * right) ^ up)
        a, b = a & (side - 1), b & (side - 1)
        mirrored = right & ~up
        a, b = np.where(mirrored, side - 1 - a, a), np.where(mirrored, side - 1 - b, b)
        a, b = np.where(up, a, b), np.where(up, b, a)
    return out


def proportional(size: np.ndarray, n: int) -> np.ndarray:
    """Inclusion probabilities proportional to size that sum to n, none above 1: of the sizes in falling order a prefix is
    certain."""
    if size.sum() <= 0:
        return np.full(len(size), n / len(size))
    order = np.argsort(-size, kind="stable")
    falling = size[order]
    rest = np.cumsum(falling[::-1])[::-1]
    certain = int(np.cumprod((n - np.arange(len(size))) * falling >= rest).sum())
    out = np.ones(len(size))
    if certain < len(size):
        out[order[certain:]] = (n - certain) * falling[certain:] / rest[certain]
    return out


class Replicate:
    """A drawn sample of a frame held in numpy: the chosen rows, probabilities of all rows and, of replicated designs, who is
    in which replicate."""

    def __init__(self, x: np.ndarray, stratum: np.ndarray, size: np.ndarray | None, n, method: str, replicates: int, seed: int, balance: np.ndarray | None = None):
        self.x, self.stratum, self.method, self.replicates = x, stratum, method, replicates
        levels = np.unique(stratum)
        z = np.ones(len(x)) if size is None else size
        if isinstance(n, dict):
            self.n = {k: int(n[str(k)]) for k in levels}
        else:
            total = z.sum()
            self.n = dict(zip(levels, largest_remainder([n * z[stratum == k].sum() / total for k in levels], int(n)), strict=True))
        self.p = np.zeros(len(x))
        self.member = np.zeros((len(x), replicates), dtype=bool)
        low, high = x.min(0), x.max(0)
        for i, k in enumerate(levels):
            own = np.flatnonzero(stratum == k)
            self.p[own] = p = proportional(z[own], self.n[k])
            self.member[own] = self._draw(x[own], p, self.n[k], np.random.default_rng([seed % 2**32, seed >> 32, i]), low, high, None if balance is None else balance[own])
        self.each = self.p / replicates
        self.pi = self.p if replicates == 1 else 1 - (1 - self.each) ** replicates
        self.chosen = np.flatnonzero(self.member.any(1))

    def _draw(self, x, p, n, random, low, high, balance) -> np.ndarray:
        seed = int(random.integers(2**62))
        out = np.zeros((len(x), self.replicates), dtype=bool)
        if self.method == "srs":
            out[random.choice(len(x), n, replace=False), 0] = True
        elif self.method == "systematic":
            order = np.lexsort((np.arange(len(x)), hilbert_place(x, low, high)))
            upto = np.round(np.concatenate([[0], np.cumsum(p[order] / self.replicates)]), 9)
            for r, start in enumerate(random.random(self.replicates)):
                out[order, r] = np.floor(upto[1:] - start) > np.floor(upto[:-1] - start)
        elif self.method == "cube":
            out[:, 0] = cube(p[:, None] if balance is None else np.column_stack([p, balance]), p, seed)
        else:
            out[:, 0] = local_pivotal(x, p, seed)
        return out

    def estimate(self, y: np.ndarray) -> tuple[float, float]:
        """Total of ``y`` (a value per row of the frame, read only where sampled) and its variance, by the rule that the
        design has: between replicates, SRS within strata, or the local mean."""
        own = self.chosen
        sizes = {k: int((self.stratum == k).sum()) for k in self.n} if self.method == "srs" else {}
        return estimated(self.method, self.n, sizes, self.x[own], self.stratum[own], y[own], self.pi[own], self.each[own], self.member[own])


def estimated(method: str, n: dict, sizes: dict, x: np.ndarray, stratum: np.ndarray, y: np.ndarray, pi: np.ndarray, each: np.ndarray, member: np.ndarray) -> tuple[float, float]:
    """The same from the sampled rows alone; ``n`` and ``sizes`` are the sample's and, for SRS, the frame's by stratum."""
    replicates = member.shape[1]
    if replicates > 1:
        totals = np.where(member, y[:, None], 0.0).T @ (1 / each)
        return float(totals.mean()), float(totals.var(ddof=1) / replicates)
    total = variance = 0.0
    for k, m in n.items():
        own = stratum == k
        total += float((y[own] / pi[own]).sum())
        if method == "srs":
            variance += sizes[k] ** 2 * (1 - m / sizes[k]) * float(y[own].var(ddof=1)) / m if m > 1 else float("nan")
        else:
            variance += local_mean(x[own], y[own] / pi[own])
    return total, variance


def local_mean(x: np.ndarray, e: np.ndarray, k: int = 3) -> float:
    """Sum of squared distances of each expanded value from the mean of itself and its k nearest."""
    out = 0.0
    for i, near in enumerate(neighbours(x, k)):
        group = np.append(near, i)
        if len(group) > 1:
            out += len(group) / (len(group) - 1) * (e[i] - e[group].mean()) ** 2
    return float(out)
