import itertools
import math

import numpy as np
import pandas as pd
import pytest

from terrasample.operators.routing import legs, route_fieldwork, route_summary
from terrasample.operators.schedule import schedule_calendar, schedule_fieldwork
from terrasample.operators import solver
from terrasample.operators.solver import EXACT, Infeasible, Problem, route_length
from terrasample.operators.travel import CostModel


def square(n, seed, size=10.0, base=(5.0, 5.0)):
    x = np.random.default_rng(seed).uniform(0, size, (n, 2))
    x = np.vstack([base, x])
    return np.sqrt(((x[:, None] - x) ** 2).sum(-1)), ["depot", *[f"u{i}" for i in range(1, n + 1)]]


def brute(d, units, stops):
    best = math.inf
    for order in itertools.permutations(units):
        value = [0.0] + [math.inf] * len(order)
        for i in range(len(order)):
            for j in range(i + 1, min(i + stops, len(order)) + 1):
                value[j] = min(value[j], value[i] + route_length(d, 0, list(order[i:j])))
        best = min(best, value[-1])
    return best


def test_exact_against_brute_force():
    d, names = square(7, 4)
    r = route_fieldwork((d, names), names[1:], "depot", max_stops=3)
    assert r.total == pytest.approx(brute(d, range(1, 8), 3)) and r.optimal and sorted(u for *_, u in r.stops) == sorted(names[1:])


def test_thirteen_units_are_solved_exactly():
    d, names = square(13, 6)
    r = route_fieldwork((d, names), names[1:], "depot", max_stops=5, service_time=0.1, max_length=60)
    assert r.optimal and sorted(u for *_, u in r.stops) == sorted(names[1:]) and max(r.durations) <= 60 and r.n_routes >= 3
    searched = solver._search(Problem(d, [0], list(range(1, 14)), np.full(14, 0.1), np.zeros(14), 60, 5), 40, None, 1)[0]
    assert r.total <= sum(route_length(d, k, x) for k, x in searched) + 1e-9


@pytest.mark.parametrize("fleet", [None, [2], [3]])
def test_exact_with_a_fleet_and_two_depots(fleet):
    d, _ = square(7, 11)
    p = Problem(d, [0] if fleet else [0, 7], list(range(1, 7)), np.zeros(8), np.ones(8), max_stops=4, capacity=3.0 if fleet == [2] else 4.0, route_cost=1.0, fleet=fleet)
    routes, value = solver._exact(p)
    best = math.inf
    for order in itertools.permutations(p.units):
        for cuts in range(1 << 5):
            parts, at = [], 0
            for i in range(6):
                if i == 5 or cuts >> i & 1:
                    parts.append(list(order[at : i + 1]))
                    at = i + 1
            if all(len(x) <= min(4, p.capacity) for x in parts) and (fleet is None or len(parts) <= fleet[0]):
                best = min(best, sum(min(route_length(d, k, x) for k in p.depots) + 1.0 for x in parts))
    assert value == pytest.approx(best) and value == pytest.approx(sum(route_length(d, k, x) + 1.0 for k, x in routes))


def test_asymmetric_total_is_the_sum_of_legs():
    d = np.random.default_rng(2).uniform(1, 10, (9, 9))
    np.fill_diagonal(d, 0)
    names = [f"p{i}" for i in range(9)]
    r = route_fieldwork((d, names), names[1:], "p0", max_stops=4)
    total = sum(route_length(d, 0, [names.index(u) for k, _, u in r.stops if k == route]) for route in range(1, r.n_routes + 1))
    assert r.total == pytest.approx(total)


def test_lattice_tour():
    g = np.array([(i, j) for i in range(5) for j in range(4)], float)
    d = np.sqrt(((g[:, None] - g) ** 2).sum(-1))
    names = [f"c{i}" for i in range(20)]
    r = route_fieldwork((d, names), names[1:], "c0", iterations=100)
    assert r.total == pytest.approx(20) and r.lower_bound == pytest.approx(20, rel=1e-6)


def test_limits_hold():
    d, names = square(25, 9)
    assert len(names) - 1 > EXACT
    r = route_fieldwork((d, names), names[1:], "depot", max_length=25, service_time=1.0, max_stops=6, iterations=10)
    assert max(r.durations) <= 25 + 1e-9 and r.total >= r.lower_bound
    assert np.allclose(np.array(r.durations) - np.array(r.lengths), [sum(1 for k, *_ in r.stops if k == i) for i in range(1, r.n_routes + 1)])
    loaded = route_fieldwork((d, names), names[1:], "depot", demand=2, capacity=10, iterations=5)
    assert max(loaded.loads) <= 10


def test_errors():
    d, names = square(4, 1)
    with pytest.raises(ValueError, match="distinct"):
        route_fieldwork((d, names), ["u1", "u1"], "depot")
    with pytest.raises(ValueError, match="depot"):
        route_fieldwork((d, names), ["u1", "depot"], "depot")
    with pytest.raises(Infeasible, match="max_length"):
        route_fieldwork((d, names), ["u1"], "depot", max_length=0.01)
    with pytest.raises(Infeasible, match="capacity"):
        route_fieldwork((d, names), ["u1"], "depot", demand=5, capacity=4)


def test_cost_model():
    m = CostModel(per_travel=2, per_unit=30, per_interview=10, interviews_per_unit=4)
    assert m.cost_of(100, 5) == {"travel": 200, "routes": 0, "units": 150, "interviews": 200, "total": 550}
    assert CostModel(per_interview=10, interviews_per_unit=lambda names: [i for i in (2, 5, 9)]).cost_of(0, 3, [2, 5, 9])["interviews"] == 160


def plan(**options):
    x = np.random.default_rng(5).uniform(0, 10, (30, 2))
    x = np.vstack([(2, 2), (8, 8), x])
    names = ["base1", "base2", *[f"s{i}" for i in range(1, 31)]]
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    return schedule_fieldwork((d, names), names[2:], 2, 4, ["base1", "base2"], max_stops=4, service_time=0.5, iterations=10, **options), (d, names, x)


def test_schedule_visits_each_unit_once():
    s, _ = plan()
    units = [u for row in s.calendar["units"] for u in row]
    assert sorted(units) == sorted(f"s{i}" for i in range(1, 31)) and s.fits
    assert not s.calendar.duplicated(["team", "day"]).any() and s.glance()["units"] == 30


def test_schedule_by_region_and_without_time():
    _, (d, names, x) = plan()
    region = {n: "west" if x[i, 0] < 5 else "east" for i, n in enumerate(names)}
    s = schedule_fieldwork((d, names), names[2:], 2, 4, ["base1", "base2"], max_stops=4, region=region, iterations=5)
    assert set(s.calendar["region"]) == {"east", "west"}
    late = schedule_fieldwork((d, names), names[2:], 1, 2, ["base1", "base2"], max_stops=4, iterations=5)
    assert not late.fits


def test_calendar_rules():
    s, _ = plan()
    c = schedule_calendar(s, availability=pd.DataFrame({"team": ["base1-1"], "day": [1], "available": [False]}))
    assert not ((c.calendar["team"] == "base1-1") & (c.calendar["day"] == 1)).any()
    c = schedule_calendar(s, fixed=pd.DataFrame({"base": ["base2"], "route": [1], "team": ["base2-1"], "day": [3]}))
    row = c.calendar[(c.calendar["base"] == "base2") & (c.calendar["route"] == 1)].iloc[0]
    assert (row["team"], row["day"]) == ("base2-1", 3)
    c = schedule_calendar(s, before=pd.DataFrame({"base": ["base1"], "route": [2], "base_after": ["base1"], "route_after": [1]}))
    day = c.calendar[c.calendar["base"] == "base1"].set_index("route")["day"]
    assert day[2] < day[1]
    with pytest.raises(Infeasible):
        schedule_calendar(s, availability=pd.DataFrame([(f"base1-{t}", d, False) for t in (1, 2) for d in range(1, 5)], columns=["team", "day", "available"]))


def test_given_routes(spark):
    stops = spark.createDataFrame([(1, 1, "a", "d"), (1, 2, "b", "d"), (2, 1, "c", "d")], "route int, stop int, unit string, depot string")
    xy = {"d": 0, "a": 1, "b": 3, "c": -2}
    travel = spark.createDataFrame([(p, q, float(abs(xy[p] - xy[q]))) for p in xy for q in xy], "`from` string, `to` string, travel double")
    assert [(r.route, r.length) for r in route_summary(stops, travel).orderBy("route").collect()] == [(1, 6.0), (2, 4.0)]
    assert [r.leg for r in legs(stops, travel).orderBy("route", "stop").collect()] == [1.0, 2.0, 2.0]
