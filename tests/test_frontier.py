import numpy as np
import pytest

from terrasample.functions.columns import HILBERT_BITS, hilbert
from terrasample.operators import frontier as M
from terrasample.operators.estimate import design_variance
from terrasample.operators.frontier import cost_variance_frontier, frontier_glance, routed_cost_curve, routed_unit_cost
from terrasample.operators.plotdata import curve_lines, frontier_lines
from terrasample.operators.pointdesign import point_design_effect
from terrasample.operators.select import select_units
from terrasample.operators.simulate import Replicate, hilbert_place, proportional
from terrasample.operators.travel import CostModel, travel_matrix
from pyspark.sql import functions as F

MODEL = CostModel(per_travel=2, per_unit=30, per_interview=10, interviews_per_unit=4, per_route=5)


@pytest.fixture(scope="module")
def frame(spark):
    r = np.random.default_rng(4)
    rows = [(f"c{i:03}", float(i % 12), float(i // 12), "west" if i % 12 < 6 else "east", float(3 + i % 12 + r.normal()), float(1 + i % 5)) for i in range(144)]
    return spark.createDataFrame([("depot", 6.5, 6.5, "none", 0.0, 0.0), *rows], "unit string, x double, y double, h string, crop double, size double").cache()


@pytest.mark.parametrize(("selection", "options"), [("srs", {}), ("lpm", {"size": "size"}), ("systematic", {"replicates": 2}), ("cube", {"size": "size"})])
def test_cost_and_variance(frame, selection, options):
    rows = cost_variance_frontier(frame, "depot", MODEL, [{"west": 4, "east": 8}, {"west": 8, "east": 12}], y="crop", strata="h", selection=selection, n_rep=3, iterations=3, **options).orderBy("n").collect()
    assert [r.n for r in rows] == [12, 20] and rows[1].allocation == {"west": 8, "east": 12} and rows[0].n_rep == 3
    assert rows[0].cost_mean < rows[1].cost_mean and all(r.cost_per_unit == pytest.approx(r.cost_mean / r.n) for r in rows)
    assert all(r.cost_mean == pytest.approx(2 * r.travel_mean + 5 * r.routes_mean + 70 * r.n) and r.variance_mean > 0 and r.cv_mean > 0 for r in rows)


@pytest.mark.parametrize("selection", ["srs", "systematic"])
def test_variances_are_those_of_the_design(spark, frame, selection):
    """The replicate's variance is that of the library's estimator on the same sample."""
    cells = frame.where("unit <> 'depot'").orderBy("unit").toPandas()
    options = {"replicates": 4} if selection == "systematic" else {}
    d = Replicate(cells[["x", "y"]].to_numpy(), cells["h"].to_numpy(), None, 24, selection, options.get("replicates", 1), 7)
    s = select_units(frame.where("unit <> 'depot'"), 24, strata="h", method=selection, **options)
    marks = cells.assign(sampled=d.member.any(1), pi=d.pi)
    if options:
        marks = marks.assign(in_replicate=d.member.tolist(), pi_replicate=d.each)
    own = type(s)(spark.createDataFrame(marks), s.design)
    want = design_variance(own, "crop").first()
    assert d.estimate(cells["crop"].to_numpy()) == (pytest.approx(want.total), pytest.approx(want.variance))


def test_draws_have_the_probabilities():
    x = np.random.default_rng(1).random((40, 2))
    size = np.arange(1.0, 41)
    p = proportional(size, 8)
    assert p.sum() == pytest.approx(8) and p.max() <= 1
    for selection in ("systematic", "lpm", "cube"):
        hits = sum(Replicate(x, np.full(40, "all"), size, 8, selection, 1, s).member[:, 0] for s in range(400))
        assert hits.sum() == 3200 and np.abs(hits / 400 - p).max() < 0.13


def test_hilbert_place_is_the_columns(spark):
    r = np.random.default_rng(2).integers(0, 1 << HILBERT_BITS, (200, 2))
    rows = spark.createDataFrame([(int(a), int(b)) for a, b in r], "a long, b long").select("a", "b", hilbert(F.col("a"), F.col("b")).alias("h")).collect()
    x = np.array([[q.a, q.b] for q in rows], dtype=float)
    assert hilbert_place(x, np.zeros(2), np.full(2, float((1 << HILBERT_BITS) - 1))).tolist() == [q.h for q in rows]


def test_matrix_and_large_frames(frame, monkeypatch):
    options = dict(n_grid=[6, 9], y="crop", selection="srs", n_rep=2, iterations=2)
    straight = cost_variance_frontier(frame, "depot", MODEL, **options).orderBy("n").collect()
    given = cost_variance_frontier(frame, "depot", MODEL, matrix=travel_matrix(frame, coords=["x", "y"]), **options).orderBy("n").collect()
    assert [r.cost_mean for r in straight] == pytest.approx([r.cost_mean for r in given])
    monkeypatch.setattr(M, "BROADCAST_UNITS", 10)
    plans = cost_variance_frontier(frame, "depot", MODEL, **options).orderBy("n").collect()
    assert [r.n for r in plans] == [6, 9] and all(r.cost_mean > 0 and r.variance_mean > 0 for r in plans)


def test_tables_and_guards(spark, frame):
    f = cost_variance_frontier(frame, "depot", MODEL, [6], n_rep=2, iterations=2)
    assert "variance_mean" not in f.columns and frontier_glance(f).first().sizes == 1
    assert frontier_lines(f).columns == ["n", "x", "y", "spread"]
    u = routed_unit_cost(frame, "depot", MODEL, 6, n_rep=2, iterations=2)
    assert u["cost_per_unit"] == pytest.approx(u["cost_mean"] / 6) and list(u) == ["n", "cost_per_unit", "travel_per_unit", "cost_mean", "routes_mean", "n_rep"]
    c = routed_cost_curve(frame, "depot", MODEL, [8, 16, 32], n_rep=2, iterations=2)
    assert c.a >= 0 and c.b >= 0 and c.r_squared > 0.9 and curve_lines(spark, c, 5).count() == 5 and "sqrt" in repr(c)
    assert list(c.glance())[:7] == ["c0", "a", "b", "r_squared", "n_min", "n_max", "n_sizes"]
    for bad, match in ((dict(n_grid=[]), "at least one"), (dict(n_grid=[5], selection="lpm", replicates=2), "systematic")):
        with pytest.raises(ValueError, match=match):
            cost_variance_frontier(frame, "depot", MODEL, **bad)
    with pytest.raises(ValueError, match="not found"):
        cost_variance_frontier(frame, "nope", MODEL, [6])
    with pytest.raises(ValueError, match="three"):
        routed_cost_curve(frame, "depot", MODEL, [10, 20])


@pytest.mark.parametrize(("method", "options"), [("srs", {}), ("lpm", {"size": "size"}), ("systematic", {"replicates": 2, "strata": "h"})])
def test_point_design_effect(spark, frame, method, options):
    r = np.random.default_rng(8)
    cells = frame.where("unit <> 'depot'")
    rows = [(f"c{i:03}-{k}", f"c{i:03}", a, float(r.gamma(3, 3))) for i in range(144) for k, a in ((1, 0.5), (2, 0.2))]
    land = spark.createDataFrame(rows, "establishment string, unit string, area double, y double")
    out, sims = point_design_effect(cells, land, 20, 6, 1.0, method=method, n_sim=120, seed=5, **options)
    d = out.first()
    assert out.columns == ["n_sim", "total", "mean_estimate", "bias", "variance", "cv", "mean_variance_estimate", "interviews", "variance_srs", "deff"]
    assert d.total == pytest.approx(sum(x[3] for x in rows)) and abs(d.bias) < 4 * (d.variance / 120) ** 0.5 and sims.count() == 120
    assert d.mean_variance_estimate == pytest.approx(d.variance, rel=0.6) and d.deff > 0
    with pytest.raises(ValueError, match="exceeds the cell area"):
        point_design_effect(cells, land.withColumn("area", F.lit(0.9)), 5, 2, 1.0, n_sim=2)


@pytest.mark.parametrize(("selection", "options"), [("srs", {}), ("lpm", {"size": "size"}), ("systematic", {"replicates": 2}), ("cube", {"size": "size"})])
def test_large_frames_are_drawn_in_one_plan(spark, frame, monkeypatch, selection, options):
    """The jobs do not grow with the replicates, and the results are those of small frames."""
    from terrasample.operators import select

    def jobs(n_rep):
        group = f"{selection}-{n_rep}"
        spark.sparkContext.setJobGroup(group, group)
        f = cost_variance_frontier(frame, "depot", MODEL, [12, 20], y="crop", strata="h", selection=selection, n_rep=n_rep, iterations=2, **options).orderBy("n").collect()
        return f, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    small = jobs(8)[0]
    monkeypatch.setattr(M, "BROADCAST_UNITS", 10)
    monkeypatch.setattr(select, "BLOCK", 16)
    (_, once), (many, again) = jobs(1), jobs(8)
    assert again <= 2 * once and [f.n for f in many] == [12, 20] and [f.n_rep for f in many] == [8, 8]
    for a, b in zip(many, small, strict=True):
        assert a.allocation == b.allocation and a.cost_mean == pytest.approx(b.cost_mean, rel=0.2)
        assert abs(a.estimate_mean - b.estimate_mean) < 5 * ((a.variance_mc + b.variance_mc) / 8) ** 0.5 + 1e-6 * b.estimate_mean


def test_what_a_block_leaves_has_the_probabilities():
    from terrasample.operators.draws import survivor
    from terrasample.operators.spatial import pivotal_flight

    p = np.array([0.0, 0.05, 0.2, 0.1, 0.25])
    x = np.random.default_rng(3).random((5, 2))
    left = [survivor(p, s) for s in range(4000)]
    assert all((v > 0).sum() == 1 and v.sum() == pytest.approx(0.6) for v in left)
    assert np.abs(np.mean(left, 0) - p).max() < 0.02 and np.abs(np.mean([pivotal_flight(x, p, s) for s in range(4000)], 0) - p).max() < 0.02
    assert survivor(np.zeros(3), 1).sum() == 0 and survivor(np.array([0.5, 0.5]), 1).max() == 1


def test_point_design_of_a_large_frame(spark, frame, monkeypatch):
    """Land and cells of any size: neither a bound in bytes nor the broadcast of the cells is needed."""
    from terrasample.operators import pointdesign as P

    monkeypatch.setattr(P, "MOST_BYTES", 1, raising=False)
    monkeypatch.setattr(P, "BROADCAST_UNITS", 10, raising=False)
    cells = frame.where("unit <> 'depot'")
    rows = [(f"{i % 48:02}-{k}", f"c{i:03}", a, float(1 + i % 48)) for i in range(120) for k, a in ((1, 0.5), (2, 0.2))]
    land = spark.createDataFrame(rows, "establishment string, unit string, area double, y double")
    out, sims = point_design_effect(cells, land, 20, 6, 1.0, method="srs", n_sim=60, seed=5)
    d = out.first()
    assert d.n_sim == 60 and d.total == sum({r[0]: r[3] for r in rows}.values()) and abs(d.bias) < 4 * (d.variance / 60) ** 0.5
    assert d.mean_variance_estimate == pytest.approx(d.variance, rel=0.6)
    with pytest.raises(ValueError, match="not in the frame"):
        point_design_effect(cells.where("unit > 'c010'"), land, 5, 2, 1.0, n_sim=2, method="srs")
