"""Registered queries hand their operators the whole table, not a part of it."""

import os

import numpy as np
import pytest

from terrasample.operators.solver import Problem, solve
from terrasample.plans import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


class Seen(Exception):
    pass


def given(monkeypatch, operator, query, spark):
    """What the query calls the operator with."""

    def record(*args, **options):
        raise Seen(args, options)

    monkeypatch.setattr(Q, operator, record)
    with pytest.raises(Seen) as e:
        Q.QUERIES[query](spark, SF)
    return e.value.args


@pytest.mark.parametrize(("operator", "query"), [("cost_variance_frontier", "frontier"), ("cost_variance_frontier", "frontier_glance"), ("routed_cost_curve", "cost_curve_fit"), ("two_stage_design", "two_stage_routed"), ("dual_frame_design", "dual_frame_routed")])
def test_all_cells_and_replicates(spark, monkeypatch, operator, query):
    args, options = given(monkeypatch, operator, query, spark)
    customers = {str(r[0]) for r in Q.read(spark, SF, "customer").select("c_custkey").collect()}
    assert {r["unit"] for r in args[0].select("unit").collect()} == customers | {"depot"}
    assert "n_rep" not in options
    if operator == "dual_frame_design":
        assert sum(d["size"] for d in args[3] if "a" in d["domain"]) == len(customers)


def test_point_deff_has_all_cells_and_areas(spark, monkeypatch):
    (cells, land, *_), options = given(monkeypatch, "point_design_effect", "point_deff", spark)
    assert cells.count() == Q.cells(spark, SF).count() and land.count() == Q.areas(spark, SF).count()
    assert "n_sim" not in options


def test_every_sampled_unit_is_routed_and_scheduled(spark):
    sampled = sorted(r["unit"] for r in Q._field_sample(spark, SF).select("unit").collect())
    assert sorted(r["unit"] for r in Q.QUERIES["routes"](spark, SF).collect()) == sampled
    plan = Q._plan(spark, SF)
    assert sorted(u for units in plan.calendar["units"] for u in units) == sampled
    assert plan.fits and not plan.calendar.duplicated(["team", "day"]).any()


def test_routes_go_to_depots_with_fleet_left():
    """All units lie at the first depot; its fleet takes half of them."""
    x = np.array([[0.0, 0.0], [50.0, 0.0], *[[i % 5, i // 5] for i in range(24)]])
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    p = Problem(d, [0, 1], list(range(2, 26)), np.zeros(26), np.zeros(26), max_stops=4, fleet=[3, 3])
    s = solve(p, 20, certify=0)
    assert sorted(u for r in s.routes for u in r) == p.units and s.route_depots.count(0) == 3
