"""Operators that SQL cannot express, against brute force and closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasample.operators import accessors, analytics as A
from terrasample.operators.allocation import dual_frame_allocation, frame_allocation, multivariate_allocation, two_stage_allocation
from terrasample.operators.estimate import cov_ht, design_variance, ratio_estimator
from terrasample.operators.plotdata import schedule_segments
from terrasample.operators.routing import route_fieldwork, route_tasks
from terrasample.operators.schedule import schedule_fieldwork
from terrasample.operators.select import select_units
from terrasample.operators.travel import travel_matrix


def moran(x, v, k):
    d = ((x[:, None] - x) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    e = v - v.mean()
    lag = np.array([e[np.lexsort((np.arange(len(v)), row))[: min(k, len(v) - 1)]].mean() for row in d])
    return (e * lag).sum() / (e * e).sum()


@pytest.mark.parametrize("kind", ["uniform", "clustered", "line", "few"])
def test_morans_i_anywhere(spark, kind):
    r = np.random.default_rng(1)
    x = {"uniform": r.random((200, 2)), "clustered": np.concatenate([r.normal(0, 0.01, (120, 2)), r.random((30, 2)) * 100]), "line": np.column_stack([np.arange(60.0) ** 2, np.zeros(60)]), "few": r.random((5, 2))}[kind]
    v = x[:, 0] + r.normal(size=len(x))  # with all others as neighbours the lag is -e / (n - 1)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, v, strict=True))], "unit long, x double, y double, v double")
    got = A.moran_i(df, "v").first()
    assert got.n == len(x) and got.moran_i == pytest.approx(moran(x, v, 8))


def test_equal_budgets(spark):
    points = [(n, 100.0 + 20 * n) for n in (10, 20, 40, 80)]
    assert A.equal_budget_size(points, 100 + 25 * 30, per_unit=5) == pytest.approx(30, rel=1e-6)
    v = spark.createDataFrame([(d, float(n), c / n) for d, c in (("srs", 100.0), ("lpm", 60.0)) for n in (5, 10, 20)], "design string, n double, variance double").withColumn("frame", F.lit("f"))
    sizes = spark.createDataFrame([("f", "srs", 15.0), ("f", "lpm", 12.0)], "frame string, design string, n double")
    got = {r.design: r.efficiency for r in A.equal_budget_efficiency(v, sizes, ["frame"]).collect()}
    assert got["srs"] == pytest.approx(1) and got["lpm"] == pytest.approx((60 / 12) / (100 / 15))


def test_average_loop_grid_and_fields(spark):
    found, cost, rounds = A.average_cost_loop(50.0, lambda c: 1000 / c, lambda n: 10 + 200 / n, rounds=200)
    assert cost == pytest.approx(10 + 0.2 * cost, rel=1e-5) and rounds < 200 and found == pytest.approx(1000 / cost, rel=1e-4)
    g = A.scenario_grid(spark, a=[1, 2], b=["x", "y", "z"])
    assert g.count() == 6 and g.columns == ["a", "b"]
    x = np.random.default_rng(0).random((30, 2))
    f = A.gaussian_field(x, 0.5, nugget=0.1, fields=4000, seed=2)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    assert np.abs(np.cov(f) - (0.9 * np.exp(-6 * d) + 0.1 * np.eye(30))).max() < 0.12


@pytest.fixture(scope="module")
def grid(spark):
    rows = [(f"c{i * 10 + j}", float(i), float(j), "low" if i < 3 else "high", 1.0 + j, 10 + 2.0 * i + j) for i in range(10) for j in range(10)]
    return spark.createDataFrame(rows, "unit string, x double, y double, h string, size double, crop double").cache()


@pytest.mark.parametrize(("method", "options"), [("srs", {}), ("lpm", {"size": "size"}), ("systematic", {"replicates": 4})])
def test_covariances_and_ratio(grid, method, options):
    s = select_units(grid, 24, strata="h", method=method, seed=5, **options)
    v = {z: design_variance(type(s)(s.df.withColumn("z", e), s.design), "z").first().variance for z, e in (("y", F.col("crop")), ("x", F.col("size")), ("sum", F.col("crop") + F.col("size")))}
    assert cov_ht(s, F.col("crop"), F.col("size")) == pytest.approx((v["sum"] - v["y"] - v["x"]) / 2, abs=1e-6 * v["y"])
    r = ratio_estimator(s, "crop", "size").first()
    off = design_variance(type(s)(s.df.withColumn("z", F.col("crop") - r.ratio * F.col("size")), s.design), "z").first()
    x_hat = 550.0 / r.total * r.ratio * 1.0
    assert r.total == pytest.approx(550.0 * r.ratio) and r.variance_ht == pytest.approx(v["y"])
    ht_x = s.df.where("sampled").agg(F.sum(F.col("size") / F.col("pi"))).first()[0] if method != "systematic" else None
    if ht_x:
        assert r.variance == pytest.approx(off.variance * (550.0 / ht_x) ** 2, rel=1e-6)
        assert r.variance_srs == pytest.approx(off.variance_srs * (550.0 / ht_x) ** 2, rel=1e-6)
    assert x_hat > 0


def test_regions_are_planned_on_the_executors(spark):
    x = np.random.default_rng(5).uniform(0, 10, (24, 2))
    x = np.vstack([(2, 2), (8, 8), x])
    names = ["base1", "base2", *[f"s{i}" for i in range(1, 25)]]
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    region = {n: "west" if x[i, 0] < 5 else "east" for i, n in enumerate(names)}
    s = schedule_fieldwork((d, names), names[2:], 2, 6, ["base1", "base2"], max_stops=4, region=region, iterations=5, service_time={"s1": 2.0})
    assert sorted(u for row in s.calendar["units"] for u in row) == sorted(names[2:]) and set(s.summary["region"]) == {"east", "west"}
    own = schedule_fieldwork((d, names), [u for u in names[2:] if region[u] == "west"], 2, 6, ["base1"], max_stops=4, iterations=5, service_time={"s1": 2.0} if region["s1"] == "west" else 0)
    assert s.calendar[s.calendar["region"] == "west"]["travel"].sum() == pytest.approx(own.calendar["travel"].sum())
    units = spark.createDataFrame([(n, float(a), float(b)) for n, (a, b) in zip(names, x, strict=True)], "unit string, x double, y double")
    drawn = schedule_segments(spark, s, units, ("x", "y")).collect()
    length = sum(((r.x - r.xend) ** 2 + (r.y - r.yend) ** 2) ** 0.5 for r in drawn)
    assert length == pytest.approx(s.calendar["travel"].sum())
    assert route_tasks(spark, [{"a": 1}, {"a": 2}], lambda t: {"b": t["a"] + 1})["result"].tolist() == [{"b": 2}, {"b": 3}]


def test_every_result_has_a_row(spark, grid):
    strata = [dict(stratum="a", size=300, sd=80, cost=60), dict(stratum="b", size=2500, sd=12, cost=35)]
    domains = [dict(domain="a", size=5000, mean=12, sd=10), dict(domain="ab", size=800, mean=90, sd=60), dict(domain="b", size=150, mean=110, sd=70)]
    m = travel_matrix(grid.limit(9), coords=["x", "y"])
    names = [r.unit for r in grid.limit(9).collect()]
    results = [
        frame_allocation(strata, budget=3000), two_stage_allocation(500, 20, 4, 25, 300, 20, budget=1e5), dual_frame_allocation(domains, 220, 35, budget=150000),
        multivariate_allocation([{**s, "p": s["sd"]} for s in strata], ["p"], target_variance=[1e8]), route_fieldwork(m, names[1:], names[0]),
    ]
    for x in results:
        assert accessors.glance(x, spark).count() == 1 and accessors.tidy(x, spark).count() > 0 and repr(x)


def test_osrm_in_one_call(spark):
    points = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.0, 1.0), ("c", 1.0, 0.0)], "unit string, lat double, lon double")

    def fetch(url):
        n = len(url.split("sources=")[1].split("&")[0].split(";"))
        k = len(url.split("destinations=")[1].split("&")[0].split(";"))
        return {"code": "Ok", "distances": [[1000.0 * (i + j) for j in range(k)] for i in range(n)], "sources": [{"distance": 1.0}] * n}

    m = travel_matrix(points, "osrm", measure="distance", block=2, fetch=fetch)
    assert m.method == "osrm" and m.unit == "km" and m.df.count() == 9 and m.df.where("`from` = `to`").agg(F.max("travel")).first()[0] == 0
    with pytest.raises(ValueError, match="only osrm"):
        travel_matrix(points, "haversine", measure="distance")
