"""Vehicle routing: exact for few units, local search with restarts for more. No Spark here."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field

import numpy as np

#: Units up to which routes are optimal by dynamic programming over subsets.
EXACT = 13


@dataclass
class Problem:
    """Travel between nodes, depots among them, and what a route may not exceed. ``fleet`` is routes per depot, None
    for no limit; ``route_cost`` is charged per route in units of travel."""

    travel: np.ndarray
    depots: list[int]
    units: list[int]
    service: np.ndarray
    demand: np.ndarray
    max_length: float = math.inf
    max_stops: float = math.inf
    capacity: float = math.inf
    route_cost: float = 0.0
    fleet: list[int | None] | None = None


@dataclass
class Solution:
    routes: list[list[int]]
    route_depots: list[int]
    lengths: list[float]
    durations: list[float]
    loads: list[float]
    total: float
    lower_bound: float
    optimal: bool
    best_iteration: int = 0
    extra: dict = field(default_factory=dict)


class Infeasible(ValueError):
    pass


def route_length(d: np.ndarray, depot: int, route: list[int]) -> float:
    if not route:
        return 0.0
    stops = [depot, *route, depot]
    return float(sum(d[a, b] for a, b in zip(stops[:-1], stops[1:], strict=True)))


def feasible(p: Problem, depot: int, route: list[int]) -> bool:
    slack = 1e-9 * max(1.0, abs(p.max_length) if math.isfinite(p.max_length) else 1.0)
    return (
        len(route) <= p.max_stops
        and p.demand[route].sum() <= p.capacity + 1e-9
        and (not math.isfinite(p.max_length) or route_length(p.travel, depot, route) + p.service[route].sum() <= p.max_length + slack)
    )


def _tours(p: Problem, depot: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By subset of the units (a bit each): the length of its shortest tour from the depot, the tour's last unit, and the
    unit before each last one. Subsets of a size are done together."""
    d, u, n = p.travel, p.units, len(p.units)
    inner, sets = d[np.ix_(u, u)], np.arange(1 << n)
    cost, back = np.full((1 << n, n), math.inf), np.full((1 << n, n), -1, dtype=np.int8)
    cost[1 << np.arange(n), np.arange(n)] = d[depot, u]
    for k in range(2, n + 1):
        own = sets[sizes == k]
        for j in range(n):
            these = own[(own >> j) & 1 == 1]
            reach = cost[these ^ (1 << j)] + inner[:, j]
            before = reach.argmin(1)
            cost[these, j], back[these, j] = reach[np.arange(len(these)), before], before
    home = cost + d[u, depot]
    last = home.argmin(1)
    return home[sets, last], last, back


def _parts(s: int) -> np.ndarray:
    """All subsets of ``s`` that have its lowest bit."""
    out = np.array([s & -s])
    rest = s & (s - 1)
    while rest:
        out = np.concatenate([out, out | (rest & -rest)])
        rest &= rest - 1
    return out


def _exact(p: Problem) -> tuple[list[tuple[int, list[int]]], float] | None:
    """Optimal routes: the shortest tour of every subset from every depot, then the cheapest partition."""
    limited = p.fleet is not None and any(f is not None for f in p.fleet)
    if limited and len(p.depots) > 1:
        return None
    n, u = len(p.units), p.units
    full = (1 << n) - 1
    has = ((np.arange(1 << n)[:, None] >> np.arange(n)) & 1).astype(float)
    sizes, busy, load = has.sum(1), has @ p.service[u], has @ p.demand[u]
    allowed = (sizes <= p.max_stops) & (load <= p.capacity + 1e-9)
    best, by, found = np.full(1 << n, math.inf), np.full(1 << n, -1), []
    for i, depot in enumerate(p.depots):
        length, last, back = _tours(p, depot, sizes)
        better = allowed & (length + busy <= p.max_length + 1e-9) & (length < best - 1e-12)
        best[better], by[better] = length[better], i
        found.append((last, back))
    best[0] = math.inf

    def route(s: int) -> tuple[int, list[int]]:
        last, back = found[by[s]]
        out, j = [], int(last[s])
        while j >= 0:
            out.append(u[j])
            s, j = s & ~(1 << j), int(back[s, j])
        return p.depots[by[int(sum(1 << u.index(x) for x in out))]], out[::-1]

    price = best + p.route_cost
    # value[s]: the cheapest routes through s, with as many routes as the layer allows
    value = np.full(1 << n, math.inf)
    value[0] = 0.0
    choices: list[np.ndarray] = []
    for _ in range(min(n, p.fleet[0]) if limited else 1):
        before = value if not limited else value.copy()
        value, pick = before.copy(), np.zeros(1 << n, dtype=np.int64)
        for s in range(1, full + 1):
            parts = _parts(s)
            sums = price[parts] + (value if not limited else before)[s ^ parts]
            i = int(sums.argmin())
            if sums[i] < value[s] - 1e-12:
                value[s], pick[s] = sums[i], parts[i]
        choices.append(pick)
    if not math.isfinite(value[full]):
        return None
    out, s, layer = [], full, len(choices) - 1
    while s:
        part = int(choices[layer][s])
        if part:
            out.append(route(part))
            s ^= part
        if limited:
            layer -= 1
    return out, float(value[full])


def _tour(d: np.ndarray, depot: int, route: list[int], passes: int = 20) -> list[int]:
    """Shorten one route by moving segments of up to three (either way round) and reversing stretches."""
    symmetric = np.allclose(d, d.T)
    stops = [depot, *route, depot]
    for _ in range(passes):
        better = False
        n = len(stops)
        if symmetric and n > 4:  # 2-opt, priced for all ends at once
            for i in range(n - 3):
                a, b = stops[i], stops[i + 1]
                rest = np.array(stops[i + 2 : n])
                gain = d[a, b] + d[rest[:-1], rest[1:]] - d[a, rest[:-1]] - d[b, rest[1:]] if len(rest) > 1 else np.zeros(0)
                if len(gain) and gain.max() > 1e-10:
                    j = i + 2 + int(gain.argmax())
                    stops[i + 1 : j + 1] = stops[i + 1 : j + 1][::-1]
                    better = True
        for size in (1, 2, 3):
            i = 1
            while i + size < len(stops):
                part = stops[i : i + size]
                rest = stops[:i] + stops[i + size :]
                cut = d[stops[i - 1], part[0]] + d[part[-1], stops[i + size]] - d[stops[i - 1], stops[i + size]]
                r = np.array(rest)
                base = d[r[:-1], r[1:]]
                ahead = d[r[:-1], part[0]] + d[part[-1], r[1:]] - base
                back = sum(d[part[k + 1], part[k]] - d[part[k], part[k + 1]] for k in range(size - 1))
                turned = d[r[:-1], part[-1]] + d[part[0], r[1:]] - base + back
                k, flip = (int(ahead.argmin()), False) if ahead.min() <= turned.min() else (int(turned.argmin()), True)
                if min(ahead.min(), turned.min()) < cut - 1e-10:
                    stops = rest[: k + 1] + (part[::-1] if flip else part) + rest[k + 1 :]
                    better = True
                i += 1
        if not better:
            break
    return stops[1:-1]


def _split(p: Problem, order: list[int]) -> list[tuple[int, list[int]]] | None:
    """Cut a giant tour into feasible routes at least cost (Prins), the best depot for each."""
    n, d = len(order), p.travel
    value, cut = [0.0] + [math.inf] * n, [(-1, -1)] * (n + 1)
    for i in range(n):
        if value[i] == math.inf:
            continue
        load = busy = inner = 0.0
        for j in range(i, n):
            u = order[j]
            load, busy = load + p.demand[u], busy + p.service[u]
            if j > i:
                inner += d[order[j - 1], u]
            if j - i + 1 > p.max_stops or load > p.capacity + 1e-9:
                break
            options = [(d[k, order[i]] + inner + d[u, k], k) for k in p.depots]
            length, depot = min(options)
            if length + busy > p.max_length + 1e-9:
                if not math.isfinite(p.max_length) or inner + busy > p.max_length:
                    break
                continue
            if value[i] + length + p.route_cost < value[j + 1] - 1e-12:
                value[j + 1], cut[j + 1] = value[i] + length + p.route_cost, (i, depot)
    if value[n] == math.inf:
        return None
    out, j = [], n
    while j:
        i, depot = cut[j]
        out.append((depot, order[i:j]))
        j = i
    return out[::-1]


def _within_fleet(p: Problem, routes: list[tuple[int, list[int]]]) -> bool:
    if p.fleet is None:
        return True
    return all(f is None or sum(k == depot for k, r in routes if r) <= f for depot, f in zip(p.depots, p.fleet, strict=True))


def _deal(p: Problem, routes: list[tuple[int, list[int]]]) -> list[tuple[int, list[int]]]:
    """Routes from other depots where one has more than its fleet, the move that adds least first. Where no move is left
    the routes stay beyond the fleet."""
    routes = [(k, r) for k, r in routes if r]
    free = {k: math.inf if f is None else f - sum(k == depot for depot, _ in routes) for k, f in zip(p.depots, p.fleet or [None] * len(p.depots), strict=True)}
    added: dict[tuple[int, int], tuple[float, list[int]]] = {}
    for i, (k, r) in enumerate(routes):
        for to in p.depots if free[k] < 0 else []:
            if free[to] > 0:
                there = _tour(p.travel, to, r)
                if feasible(p, to, there):
                    added[i, to] = route_length(p.travel, to, there) - route_length(p.travel, k, r), there
    for (i, to), (_, there) in sorted(added.items(), key=lambda x: (x[1][0], x[0])):
        k = routes[i][0]
        if free[k] < 0 < free[to]:
            routes[i] = (to, there)
            free[k], free[to] = free[k] + 1, free[to] - 1
    return routes


def _price(p: Problem, routes: list[tuple[int, list[int]]]) -> float:
    return sum(route_length(p.travel, k, r) + p.route_cost for k, r in routes if r)


class _Places:
    """The stops of all routes as arrays, so that a unit is priced against all of them at once."""

    def __init__(self, p: Problem, routes: list[tuple[int, list[int]]]):
        self.p = p
        flat = [[k, *r, k] for k, r in routes]
        # gaps: between which nodes of which route something may come
        self.before = np.array([x for s in flat for x in s[:-1]])
        self.after = np.array([x for s in flat for x in s[1:]])
        self.gap_of = np.repeat(np.arange(len(flat)), [len(s) - 1 for s in flat])
        self.gap_at = np.concatenate([np.arange(len(s) - 1) for s in flat])
        # stops: units with what stands before and behind them
        self.unit = np.array([x for s in flat for x in s[1:-1]])
        self.left = np.array([x for s in flat for x in s[:-2]])
        self.right = np.array([x for s in flat for x in s[2:]])
        self.of = np.repeat(np.arange(len(flat)), [len(s) - 2 for s in flat])
        self.at = np.concatenate([np.arange(len(s) - 2) for s in flat])
        d = p.travel
        self.gap = d[self.before, self.after]
        self.around = d[self.left, self.unit] + d[self.unit, self.right]
        self.stops = np.bincount(self.of, minlength=len(flat))
        self.load = np.bincount(self.of, p.demand[self.unit], minlength=len(flat))
        self.busy = np.bincount(self.gap_of, self.gap, minlength=len(flat)) + np.bincount(self.of, p.service[self.unit], minlength=len(flat))

    def best_moves(self) -> list[tuple[int, int, int, int, int]]:
        """For every stop the move that saves most, to a gap of another route or in exchange with another route's stop,
        if it saves anything: its route and place, the other route and place, and the unit that comes back (-1 for
        none). The best first; of moves that touch a route only the best."""
        p, d, u, a = self.p, self.p.travel, self.unit, self.of
        need, time, limit = p.demand[u], p.service[u], p.max_length * (1 + 1e-12)
        saved = self.around - d[self.left, self.right] + p.route_cost * (self.stops[a] == 1)
        r = self.gap_of[:, None]
        add = d[np.ix_(self.before, u)] + d[np.ix_(u, self.after)].T - self.gap[:, None]
        fits = (r != a) & (self.stops[r] < p.max_stops) & (self.load[r] + need <= p.capacity + 1e-9) & (self.busy[r] + add + time <= limit)
        moved = np.where(fits, saved - add, -np.inf)
        # put[v, u]: what it adds that u stands where v does
        put = d[np.ix_(self.left, u)] + d[np.ix_(u, self.right)].T - self.around[:, None]
        more, longer = need - need[:, None], put + time - time[:, None]
        fits = (a[:, None] != a) & (self.load[a][:, None] + more <= p.capacity + 1e-9) & (self.load[a] - more <= p.capacity + 1e-9)
        fits &= (self.busy[a][:, None] + longer <= limit) & (self.busy[a] + longer.T <= limit)
        swapped = np.where(fits, -(put + put.T), -np.inf)
        i, j, each = moved.argmax(0), swapped.argmax(0), np.arange(len(u))
        gain = np.maximum(moved[i, each], swapped[j, each])
        out, touched = [], set()
        for k in np.argsort(-gain, kind="stable").tolist():
            if gain[k] <= 1e-10:
                break
            swap = swapped[j[k], k] > moved[i[k], k]
            b, at, back = (int(a[j[k]]), int(self.at[j[k]]), int(u[j[k]])) if swap else (int(self.gap_of[i[k]]), int(self.gap_at[i[k]]), -1)
            if a[k] not in touched and b not in touched:
                out.append((int(a[k]), int(self.at[k]), b, at, back))
                touched |= {int(a[k]), b}
        return out


def _between(p: Problem, routes: list[tuple[int, list[int]]], stop: float, known: dict | None = None) -> list[tuple[int, list[int]]]:
    """Move and swap units between routes while that shortens them. ``known`` remembers routes that are short already."""
    routes, known = [(k, list(r)) for k, r in routes if r], {} if known is None else known

    def short(k: int, r: list[int]) -> list[int]:
        key = (k, *r)
        if key not in known:
            if len(known) > 50_000:
                known.clear()
            known[key] = _tour(p.travel, k, r)
            known[k, *known[key]] = known[key]
        return list(known[key])

    while True:
        routes = [(k, short(k, r)) for k, r in routes if r]
        moves = _Places(p, routes).best_moves() if len(routes) > 1 and time.monotonic() < stop else []
        if not moves:
            return routes
        while moves:  # between routes only, which are shortened when no move is left
            for a, at, b, i, back in moves:
                u = routes[a][1][at]
                if back >= 0:
                    routes[b][1][i], routes[a][1][at] = u, back
                else:
                    routes[b][1].insert(i, routes[a][1].pop(at))
            routes = [(k, r) for k, r in routes if r]
            moves = _Places(p, routes).best_moves() if len(routes) > 1 and time.monotonic() < stop else []


def _search(p: Problem, iterations: int, time_limit: float | None, seed: int) -> tuple[list[tuple[int, list[int]]], int]:
    """Iterated local search on giant tours: split, improve, keep if not worse, disturb a stretch, repeat."""
    random = np.random.default_rng(seed)
    d, stop = p.travel, time.monotonic() + (time_limit if time_limit is not None else math.inf)
    left, at, order = set(p.units), p.depots[0], []
    while left:
        at = min(left, key=lambda u: (d[at, u], u))
        order.append(at)
        left.remove(at)
    best: list[tuple[int, list[int]]] | None = None
    best_cost, best_at, current, current_cost = math.inf, 0, None, math.inf
    order, known = _tour(d, p.depots[0], order), {}
    for it in range(max(1, iterations)):
        found = _split(p, order)
        if found is not None:
            found = _between(p, found, stop, known)
            if not _within_fleet(p, found):
                found = _between(p, _deal(p, found), stop, known)
            if _within_fleet(p, found):
                cost = _price(p, found)
                if cost < best_cost - 1e-10:
                    best, best_cost, best_at = found, cost, it
                if cost <= current_cost + 1e-10 or random.random() < 0.02:
                    current, current_cost = found, cost
            elif best is None:
                current, current_cost = found, math.inf
        if time.monotonic() > stop:
            break
        base = [u for _, r in (current or found or [(0, order)]) for u in r] or order
        order = list(base)
        kind = random.integers(3)
        n = len(order)
        if n > 3 and kind == 0:  # double bridge
            a, b, c = sorted(random.choice(np.arange(1, n), 3, replace=False).tolist())
            order = order[:a] + order[b:c] + order[a:b] + order[c:]
        else:  # a unit and its neighbours go where they cost least
            centre = int(random.choice(p.units))
            near = sorted(p.units, key=lambda u: d[centre, u])[: max(2, min(n // 3, int(random.integers(3, 12))))]
            order = [u for u in order if u not in set(near)]
            for u in random.permutation(near).tolist():
                s = np.array([p.depots[0], *order, p.depots[0]])
                add = d[s[:-1], u] + d[u, s[1:]] - d[s[:-1], s[1:]]
                i = int((add * random.uniform(0.9, 1.1, len(add))).argmin())
                order.insert(i, int(u))
    if best is None:
        raise Infeasible("no plan fits the routes available")
    return best, best_at


def bound(p: Problem, tour: float = math.inf, rounds: int = 100) -> float:
    """A lower bound on total travel: half of every node's cheapest way in and out, or for one symmetric tour the
    Held-Karp 1-tree bound."""
    nodes = [*p.depots, *p.units]
    d = p.travel[np.ix_(nodes, nodes)].astype(float).copy()
    np.fill_diagonal(d, math.inf)
    if len(nodes) < 2:
        return 0.0
    half = float((d.min(1) + d.min(0))[len(p.depots) - 1 :].sum() / 2) if len(p.depots) == 1 else float((d.min(1) + d.min(0))[len(p.depots) :].sum() / 2)
    single = len(p.depots) == 1 and not math.isfinite(p.max_length) and not math.isfinite(p.max_stops) and not math.isfinite(p.capacity)
    if not single or len(nodes) < 4 or not np.allclose(p.travel, p.travel.T):
        return half
    n, price, best, step = len(nodes), np.zeros(len(nodes)), half, 1.0
    target = tour if math.isfinite(tour) else half * 1.5
    for r in range(rounds):
        w = d + price[:, None] + price[None, :]
        degree, cost = np.zeros(n), 0.0
        inside, near, by = np.zeros(n, dtype=bool), w[1].copy(), np.full(n, 1)
        inside[[0, 1]] = True
        for _ in range(n - 2):  # spanning tree of all nodes but the first
            j = int(np.where(inside, math.inf, near).argmin())
            cost, inside[j] = cost + near[j], True
            degree[j] += 1
            degree[by[j]] += 1
            closer = w[j] < near
            near, by = np.where(closer, w[j], near), np.where(closer, j, by)
        two = np.argsort(w[0])[:2]
        cost += w[0, two].sum()
        degree[0] += 2
        degree[two] += 1
        value = cost - 2 * price.sum()
        best = max(best, value)
        off = degree - 2
        if not off.any():
            break
        price += step * max(0.0, target - value) / (off @ off) * off
        step *= 0.97 if r > rounds // 3 else 1.0
    return min(best, tour) if math.isfinite(tour) else best


def solve(p: Problem, iterations: int = 200, time_limit: float | None = None, certify: float = 1.0, seed: int = 1) -> Solution:
    """Routes of least travel (plus the cost of routes). Raises Infeasible where no plan fits."""
    d = p.travel
    for u in p.units:
        if p.demand[u] > p.capacity + 1e-9:
            raise Infeasible(f"unit {u} demands more than a route can carry")
        if min(d[k, u] + d[u, k] for k in p.depots) + p.service[u] > p.max_length + 1e-9:
            raise Infeasible(f"unit {u} cannot be reached and served within max_length")
    if not p.units:
        return Solution([], [], [], [], [], 0.0, 0.0, True)
    exact = _exact(p) if len(p.units) <= EXACT else None
    found, best_at = (exact[0], 0) if exact else _search(p, iterations, time_limit, seed)
    found = [(k, r) for k, r in found if r]
    lengths = [route_length(d, k, r) for k, r in found]
    total = float(sum(lengths))
    if exact:
        lower = total
    else:
        lower = bound(p, total, 300 if certify > 0 else 0) if certify > 0 else bound(p, total, 0)
    return Solution(
        [r for _, r in found], [k for k, _ in found], lengths, [x + float(p.service[r].sum()) for x, (_, r) in zip(lengths, found, strict=True)],
        [float(p.demand[r].sum()) for _, r in found], total, lower, bool(exact) or total <= lower * (1 + 1e-9), best_at,
    )
