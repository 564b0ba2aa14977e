import math
from dataclasses import dataclass

import pytest

from terrasample.operators.allocation import dual_frame_allocation, frame_allocation, multivariate_allocation, two_stage_allocation, two_stage_variance
from terrasample.operators.costcurve import fit_cost_curve
from terrasample.operators.design import RoutedPrices, consistent, dearest_affordable, two_stage_design
from terrasample.operators.travel import CostModel

STRATA = [dict(stratum="a", size=300, sd=80, cost=60), dict(stratum="b", size=2500, sd=12, cost=35), dict(stratum="c", size=900, sd=35, cost=190)]


def test_target_variance():
    a = frame_allocation(STRATA, target_variance=2.5e7)
    assert a.n == [88, 143, 65] and a.cost == 22635 and a.variance <= 2.5e7 and not a.bounded


def test_budget():
    a = frame_allocation(STRATA, budget=30000)
    assert a.n == [116, 191, 86] and a.cost <= 30000


def test_loose_target_hits_the_least_sizes():
    a = frame_allocation(STRATA, target_variance=1e12)
    assert a.n == [2, 2, 2] and a.bounded


def test_one_of():
    with pytest.raises(ValueError, match="exactly one"):
        frame_allocation(STRATA)


def test_multivariate():
    rows = [dict(stratum="l", size=2000, cost=40, p=12, q=30), dict(stratum="h", size=300, cost=200, p=35, q=10), dict(stratum="w", size=500, cost=160, p=18, q=25)]
    a = multivariate_allocation(rows, ["p", "q"], target_cv=[0.04, 0.06], totals=[120000, 90000])
    assert a.n == [169, 7, 19] and a.cost == 11200
    assert a.multipliers == pytest.approx([6.16e-5, 3.05e-4], rel=1e-2)
    assert a.attained == pytest.approx([22603942, 28668674], rel=1e-6)


def test_one_variable_equals_the_single_allocation():
    rows = [{**s, "v": s["sd"]} for s in STRATA]
    assert multivariate_allocation(rows, ["v"], target_variance=[2.5e7]).n == frame_allocation(STRATA, target_variance=2.5e7).n


DOMAINS = [dict(domain="a", size=5000, mean=12, sd=10), dict(domain="ab", size=800, mean=90, sd=60), dict(domain="b", size=150, mean=110, sd=70)]


def test_dual_frame_budget():
    a = dual_frame_allocation(DOMAINS, 220, 35, deff_a=1.6, budget=150000)
    assert (a.n_a, a.n_b, a.theta) == (530, 950, pytest.approx(0.088)) and a.variance == pytest.approx(8492000, rel=1e-3)
    assert a.overlap_a == pytest.approx(73.1, abs=0.05)


def test_two_stage_against_the_grid():
    a = two_stage_allocation(5000, 20, 4, 25, 300, 20, budget=1e5)
    assert a.m == 12 and a.m_optimal == pytest.approx(11.677, abs=1e-3)
    best = min((two_stage_variance(n, m, 5000, 20, 4, 25), n, m) for m in range(1, 21) if (n := math.floor(1e5 / (300 + 20 * m))) >= 2)
    assert best[1:] == (a.n, a.m)


def test_cost_curve():
    c = fit_cost_curve([(n, 500 + 30 * n + 200 * math.sqrt(n)) for n in (10, 20, 40, 80, 160)])
    assert (c.c0, c.a, c.b) == (pytest.approx(500), pytest.approx(30), pytest.approx(200)) and c.marginal(100) == pytest.approx(40)
    c = fit_cost_curve([(10, 100), (20, 250), (40, 700)])
    assert c.a >= 0 and c.b >= 0
    c = fit_cost_curve([(10, 700), (20, 250), (40, 100)])
    assert c.a >= 0 and c.b >= 0


@dataclass(frozen=True)
class Step:
    n: int
    cost: float
    variance: float = 0.0


def test_the_dearest_design_that_the_real_price_affords():
    def allocate(money):
        if money < 6:
            raise ValueError("too little")
        return Step(int(money // 3), 3.0 * int(money // 3))

    for real in (lambda a: 4.0 * a.n, lambda a: 20 + 3.0 * a.n, lambda a: 10 * math.sqrt(a.n) + 2.5 * a.n, lambda a: 1.0 * a.n):
        affordable = [n for n in range(2, 34) if real(Step(n, 0)) <= 100]
        assert dearest_affordable(100, allocate, real).n == max(affordable)
    assert dearest_affordable(100, allocate, lambda a: 1000.0).n == 33  # nothing is affordable
    with pytest.raises(ValueError):
        dearest_affordable(5, allocate, lambda a: 1.0)


def test_a_walk_ends_in_the_best_design_of_its_cycle():
    prices = RoutedPrices(lambda sizes: {n: 100.0 + 10 * n for n in sizes}, 1000)
    walk = iter([30, 50, 40, 60, 50, 99])
    d = consistent(1.0, lambda price, curve: Step(next(walk), 0.0, 1.0), lambda a: a.n, lambda a: (a.n,), lambda a, c: c.total(a.n), prices, None, 20)
    assert d.converged and d.allocation.n == 40 and len(d.history) == 5 and d.unit_cost == pytest.approx(10)
    still = consistent(1.0, lambda price, curve: Step(25, 0.0, 1.0), lambda a: a.n, lambda a: (a.n,), lambda a, c: c.total(a.n), prices, None, 20)
    assert still.converged and len(still.history) == 2 and still.cost == pytest.approx(350)


def test_two_stage_design_is_near_the_best_on_its_curve(spark):
    cells = [(f"c{i}", float(i % 12), float(i // 12)) for i in range(144)]
    frame = spark.createDataFrame([("depot", 5.5, 5.5), *cells], "unit string, x double, y double")
    model = CostModel(per_travel=3, per_unit=40, per_interview=20)
    d = two_stage_design(frame, "depot", model, 12, 9, 40, target_cv=0.05, mean=10, n_rep=2, iterations=3)
    a, target = d.allocation, (0.05 * 10) ** 2
    grid = [(d.curve.total(n) + 20 * n * m, n, m) for n in range(2, 145) for m in range(1, 13) if two_stage_variance(n, m, 144, 12, 9, 40) <= target]
    assert d.converged and d.cost <= min(grid)[0] * 1.01 and d.unit_cost < d.average_cost
    assert d.unit_cost == pytest.approx(d.curve.marginal(a.n)) and d.cost == pytest.approx(d.curve.total(a.n) + 20 * a.n * a.m)
    b = two_stage_design(frame, "depot", model, 12, 9, 40, budget=d.cost, n_rep=2, iterations=3)
    assert 0.95 * d.cost <= b.cost <= d.cost + 1e-6 and b.mode == "budget"
