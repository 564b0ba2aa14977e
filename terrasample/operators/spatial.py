"""Numpy kernels that are sequential by nature: local pivotal, cube, neighbours. No Spark here."""

from __future__ import annotations

from random import Random

import numpy as np


class Grid:
    """Points in square cells of their first two coordinates; distance over the first two never exceeds the distance
    over all, so rings of cells bound a search in any dimension."""

    def __init__(self, x: np.ndarray, per_cell: float = 2.0):
        self.x = np.ascontiguousarray(x, dtype=float)
        flat = self.x[:, :2] if self.x.shape[1] >= 2 else np.column_stack([self.x[:, 0], np.zeros(len(x))])
        self.low = flat.min(0) if len(x) else np.zeros(2)
        span = flat.max(0) - self.low if len(x) else np.ones(2)
        area = np.prod(np.where(span > 0, span, 1))
        self.width = max(np.sqrt(area * per_cell / max(1, len(x))), float(span.max()) / 4096, 1e-12)
        self.shape = (np.floor(span / self.width) + 1).astype(int)
        cell = np.minimum(np.floor((flat - self.low) / self.width).astype(int), self.shape - 1)
        self.cell = cell
        key = cell[:, 0] * self.shape[1] + cell[:, 1]
        order = np.argsort(key, kind="stable")
        edges = np.searchsorted(key[order], np.arange(self.shape[0] * self.shape[1] + 1))
        self.members = {k: order[edges[k] : edges[k + 1]].tolist() for k in np.unique(key).tolist()}

    def ring(self, at: tuple[int, int], r: int):
        """Members of the cells at ring ``r`` around a cell."""
        cx, cy = at
        rows, cols = self.shape
        for i in range(max(0, cx - r), min(rows - 1, cx + r) + 1):
            js = range(max(0, cy - r), min(cols - 1, cy + r) + 1) if abs(i - cx) == r else [j for j in (cy - r, cy + r) if 0 <= j < cols]
            for j in js:
                yield from self.members.get(i * cols + j, ())

    def nearest(self, point: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest members with all ties, and their squared distances, in order of (distance, index)."""
        flat = np.array([point[0], point[1] if len(point) > 1 else 0.0])
        at = np.clip(np.floor((flat - self.low) / self.width).astype(int), 0, self.shape - 1)
        centre_gap = np.maximum(0, np.maximum(self.low + at * self.width - flat, flat - self.low - (at + 1) * self.width)).max()
        found: list[int] = []
        r, last = 0, int(self.shape.max())
        while True:
            found += [i for i in self.ring((int(at[0]), int(at[1])), r) if i != skip]
            if len(found) >= k or r >= last:
                d = ((self.x[found] - point) ** 2).sum(1)
                if r >= last:
                    break
                # what lies beyond ring r is at least this far away
                inner = np.minimum(flat - (self.low + (at - r) * self.width), self.low + (at + r + 1) * self.width - flat).min()
                if centre_gap == 0 and inner > 0 and np.partition(d, k - 1)[k - 1] < inner * inner * (1 - 1e-12):
                    break
            r += 1
        found_at, d = np.array(found, dtype=int), np.asarray(d if found else [], dtype=float)
        if len(d) > k:
            edge = np.partition(d, k - 1)[k - 1]
            near = d <= edge * (1 + 1e-12)
            found_at, d = found_at[near], d[near]
        order = np.lexsort((found_at, d))
        return found_at[order], d[order]


def neighbours(x: np.ndarray, k: int) -> list[np.ndarray]:
    """For each point the k nearest others, ties included."""
    grid = Grid(x)
    return [grid.nearest(x[i], min(k, len(x) - 1), skip=i)[0] if len(x) > 1 else np.zeros(0, dtype=int) for i in range(len(x))]


class _Open:
    """Undecided units in grid cells, in plain lists: a search looks at a handful of units, where numpy calls cost more
    than the arithmetic. Cells grow again as units are decided."""

    def __init__(self, x: np.ndarray):
        self.x = x.tolist()
        self.flat = x[:, :2].tolist() if x.shape[1] > 1 else [[v[0], 0.0] for v in self.x]
        self.plane = x.shape[1] <= 2

    def build(self, units: list[int]) -> None:
        xs, ys = [self.flat[u][0] for u in units], [self.flat[u][1] for u in units]
        self.x0, self.y0 = min(xs), min(ys)
        spans = [max(xs) - self.x0, max(ys) - self.y0]
        wide = [v for v in spans if v > 0]
        area = float(np.prod(wide)) if wide else 1.0
        self.w = max((area * 2 / len(units)) ** (1 / max(1, len(wide))), max(spans) / 4096, 1e-12)
        self.last = int(max(spans) / self.w) + 1
        self.cells: dict[tuple[int, int], list[int]] = {}
        for u in units:
            self.cells.setdefault(self.cell(u), []).append(u)
        self.built = len(units)

    def cell(self, u: int) -> tuple[int, int]:
        a, b = self.flat[u]
        return int((a - self.x0) / self.w), int((b - self.y0) / self.w)

    def drop(self, u: int) -> None:
        self.cells[self.cell(u)].remove(u)

    def nearest(self, u: int) -> list[int]:
        """All open units at the least distance from ``u``."""
        cx, cy = self.cell(u)
        px, py = self.flat[u]
        cells, flat, best, found, r = self.cells, self.flat, float("inf"), [], 0
        while r <= self.last:
            if r:
                ring = [(cx + i, cy + j) for i in (-r, r) for j in range(-r, r + 1)] + [(cx + i, cy + j) for i in range(1 - r, r) for j in (-r, r)]
            else:
                ring = [(cx, cy)]
            for key in ring:
                for v in cells.get(key, ()):
                    if v == u:
                        continue
                    q = flat[v]
                    d = (q[0] - px) ** 2 + (q[1] - py) ** 2
                    if not self.plane and d <= best:
                        d = sum((s - t) ** 2 for s, t in zip(self.x[u], self.x[v], strict=True))
                    if d < best * (1 - 1e-12):
                        best, found = d, [v]
                    elif d <= best * (1 + 1e-12):
                        found.append(v)
            low = min(px - self.x0 - (cx - r) * self.w, (cx + r + 1) * self.w - px + self.x0, py - self.y0 - (cy - r) * self.w, (cy + r + 1) * self.w - py + self.y0)
            if found and low > 0 and best < low * low * (1 - 1e-9):
                break
            r += 1
        return found


def pivotal_flight(x: np.ndarray, pi: np.ndarray, seed: int) -> np.ndarray:
    """Local pivotal method 2 (Grafström, Lundström and Schelin 2012): a random undecided unit fights its nearest
    undecided neighbour until at most one is undecided. Returns probabilities: 1, 0, and of that one what is left."""
    random = Random(int(seed))
    eps = 1e-9
    p = [float(v) for v in pi]
    units = [u for u, v in enumerate(p) if eps < v < 1 - eps]
    if units:
        where = {u: n for n, u in enumerate(units)}
        near = _Open(np.asarray(x, dtype=float))
        near.build(units)
    while len(units) > 1:
        if len(units) * 4 < near.built:
            near.build(units)
        i = units[random.randrange(len(units))]
        ties = near.nearest(i)
        j = ties[0] if len(ties) == 1 else ties[random.randrange(len(ties))]
        a, b = p[i], p[j]
        total, u = a + b, random.random()
        if total < 1:
            p[i], p[j] = (0.0, total) if u < b / total else (total, 0.0)
        else:
            p[i], p[j] = (1.0, total - 1) if total >= 2 or u < (1 - b) / (2 - total) else (total - 1, 1.0)
        for k in (i, j):
            if not eps < p[k] < 1 - eps:
                near.drop(k)
                at, last = where.pop(k), units.pop()
                if last != k:
                    units[at] = last
                    where[last] = at
    out = np.array(p)
    out[out <= eps], out[out >= 1 - eps] = 0.0, 1.0
    return out


def local_pivotal(x: np.ndarray, pi: np.ndarray, seed: int) -> np.ndarray:
    """Whether each unit is drawn; the sample size is fixed if the sum of ``pi`` is whole."""
    p = pivotal_flight(x, pi, seed)
    return p > Random(int(seed) + 1).random()


def _flight(a: np.ndarray, p: np.ndarray, q: int, order: np.ndarray, random: np.random.Generator) -> None:
    """Move probabilities, ``q`` of whose balancing sums stay as they are, until too few are undecided to go on."""
    eps = 1e-9
    free = [int(i) for i in order if eps < p[i] < 1 - eps]
    at, block = 0, []
    while True:
        while at < len(free) and len(block) < q + 1:
            block.append(free[at])
            at += 1
        if not block:
            return
        m = a[block][:, :q].T
        if len(block) <= q and np.linalg.matrix_rank(m, tol=1e-8) >= len(block):
            return  # fewer units than sums, and no direction is left
        u = np.linalg.svd(m)[2][-1] if q else np.eye(len(block))[0]
        if q and np.abs(m @ u).max() > 1e-6 * max(1.0, np.abs(m).max()):
            return
        now = p[block]
        up = np.min(np.where(u > 1e-12, (1 - now) / np.where(u > 1e-12, u, 1), np.where(u < -1e-12, -now / np.where(u < -1e-12, u, 1), np.inf)))
        down = np.min(np.where(u > 1e-12, now / np.where(u > 1e-12, u, 1), np.where(u < -1e-12, (now - 1) / np.where(u < -1e-12, u, 1), np.inf)))
        step = up if random.random() < down / (up + down) else -down
        p[block] = np.clip(now + step * u, 0, 1)
        block = [i for i in block if eps < p[i] < 1 - eps]


def _per_unit(balance: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.divide(balance, p[:, None], out=np.zeros_like(balance, dtype=float), where=p[:, None] > 1e-9)


def cube_flight(balance: np.ndarray, pi: np.ndarray, seed: int) -> np.ndarray:
    """The flight of the cube method (Deville and Tillé 2004): probabilities of which about as many are undecided as there
    are balancing variables. The first variable is ``pi``, which fixes the size."""
    random, p = np.random.default_rng(seed), np.array(pi, dtype=float)
    _flight(_per_unit(balance, p), p, balance.shape[1], random.permutation(len(p)), random)
    p[p <= 1e-9], p[p >= 1 - 1e-9] = 0.0, 1.0
    return p


def cube(balance: np.ndarray, pi: np.ndarray, seed: int, start: np.ndarray | None = None) -> np.ndarray:
    """Flight, then landing by dropping the last variables one by one. ``start`` are probabilities that a flight has left,
    for which the sums are those of ``pi``."""
    random, p = np.random.default_rng(seed), np.array(pi if start is None else start, dtype=float)
    a = _per_unit(balance, np.array(pi, dtype=float))
    order = random.permutation(len(p))
    for q in range(balance.shape[1], -1, -1):
        _flight(a, p, q, order, random)
    return p >= 0.5


def _by_distance(frame: np.ndarray, sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All distances, a block at a time."""
    at, best = np.empty(len(frame), dtype=int), np.empty(len(frame))
    step = max(1, 2_000_000 // max(1, len(sample)))
    for a in range(0, len(frame), step):
        d = np.zeros((len(frame[a : a + step]), len(sample)))
        for c in range(frame.shape[1]):
            d += (frame[a : a + step, c, None] - sample[None, :, c]) ** 2
        at[a : a + step] = d.argmin(1)
        best[a : a + step] = d.min(1)
    return at, best


#: Sampled points from which a search by cells costs less than all distances.
MANY = 2048


def nearest_sampled(frame: np.ndarray, sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest sampled point of each frame point, the lowest of ties, and the squared distance.

    Of many sampled points only those in the cell of a frame point and the eight around it are looked at, for all frame
    points together; who is nearer to the edge of these cells than to any of them looks again in cells four times as wide.
    """
    if len(sample) <= MANY:
        return _by_distance(frame, sample)
    flat, own = (x[:, :2] if x.shape[1] > 1 else np.column_stack([x[:, 0], np.zeros(len(x))]) for x in (sample, frame))
    low = np.minimum(flat.min(0), own.min(0))
    span = np.maximum(flat.max(0), own.max(0)) - low
    width = max(float(np.sqrt(np.prod(np.where(span > 0, span, 1)) * 2 / len(sample))), float(span.max()) / 4096, 1e-12)
    at, best = np.full(len(frame), -1), np.full(len(frame), np.inf)
    left = np.arange(len(frame))
    while len(left):
        if width * 3 >= span.max():
            at[left], best[left] = _by_distance(frame[left], sample)
            break
        shape = (span // width + 1).astype(np.int64)
        cell = ((flat - low) // width).astype(np.int64)
        key = cell[:, 0] * shape[1] + cell[:, 1]
        order = np.argsort(key, kind="stable")
        key = key[order]
        for a in range(0, len(left), 200_000):
            some = left[a : a + 200_000]
            place = ((own[some] - low) // width).astype(np.int64)
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    x, y = place[:, 0] + i, place[:, 1] + j
                    inside = (x >= 0) & (x < shape[0]) & (y >= 0) & (y < shape[1])
                    wanted = np.where(inside, x * shape[1] + y, -1)
                    first, last = np.searchsorted(key, wanted, "left"), np.searchsorted(key, wanted, "right")
                    count = np.where(inside, last - first, 0)
                    for k in range(int(count.max(initial=0))):  # cells hold a few points each
                        asks = np.flatnonzero(count > k)
                        point, who = order[first[asks] + k], some[asks]
                        d = ((frame[who] - sample[point]) ** 2).sum(1)
                        closer = (d < best[who]) | ((d == best[who]) & (point < at[who]))
                        at[who[closer]], best[who[closer]] = point[closer], d[closer]
        inner = own[left] - low - ((own[left] - low) // width) * width
        edge = np.minimum(inner, width - inner).min(1) + width
        left = left[best[left] >= edge * edge * (1 - 1e-9)]
        width *= 4
    return at, best
