import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasample.operators.estimate import design_variance, ht_covariances, ht_variance, segment_estimator
from terrasample.operators.ordering import lowest, running_total, with_index
from terrasample.operators.points import expected_hits, select_points
from terrasample.operators.overlap import frame_overlap
from terrasample.operators.select import select_units
from terrasample.operators import spatial
from terrasample.operators.spatial import cube, local_pivotal, neighbours


@pytest.fixture(scope="module")
def grid(spark):
    rows = [(f"c{i * 10 + j}", float(i), float(j), "low" if i < 3 else "high", 1.0 + j, 10 + 2.0 * i + j) for i in range(10) for j in range(10)]
    return spark.createDataFrame(rows, "unit string, x double, y double, h string, size double, crop double").cache()


@pytest.mark.parametrize("method", ["srs", "systematic", "lpm", "cube"])
def test_fixed_size_and_determinism(grid, method):
    options = {} if method == "srs" else {"size": "size"}
    one = select_units(grid, 20, method=method, strata="h", seed=3, **options)
    two = select_units(grid.repartition(7), 20, method=method, strata="h", seed=3, **options)
    first, second = ({r.unit for r in s.sampled().collect()} for s in (one, two))
    assert len(first) == 20 and first == second
    assert one.df.count() == 100 and one.df.agg(F.sum("pi")).first()[0] == pytest.approx(20)


def test_replicates(grid):
    s = select_units(grid, 20, method="systematic", replicates=4, seed=2)
    counts = s.df.select(F.posexplode("in_replicate").alias("k", "t")).where("t").groupBy("k").count().collect()
    assert sorted(r["count"] for r in counts) == [5, 5, 5, 5]
    assert ht_variance(s, F.col("crop")).first()["df"] == 3


def test_guards(grid):
    with pytest.raises(ValueError, match="simple random"):
        select_units(grid, 5, size="size", method="srs")
    with pytest.raises(ValueError, match="strata"):
        select_units(grid, 1, strata="h")
    with pytest.raises(ValueError, match="fewer than n"):
        select_units(grid, {"low": 31, "high": 5}, strata="h")
    with pytest.raises(ValueError, match="cover"):
        select_units(grid, {"low": 3}, strata="h")
    with pytest.raises(ValueError, match="replicates"):
        select_units(grid, 5, method="lpm", replicates=2)


def test_stratified_srs_by_hand(grid):
    s = select_units(grid, 20, method="srs", strata="h", seed=1)
    pdf = s.df.toPandas()
    v = sum(len(g) ** 2 * (1 - g.sampled.sum() / len(g)) * g[g.sampled].crop.var() / g.sampled.sum() for _, g in pdf.groupby("h"))
    r = design_variance(s, "crop").first()
    assert r["variance"] == pytest.approx(v) and r["total"] == pytest.approx((pdf[pdf.sampled].crop / pdf[pdf.sampled].pi).sum())
    assert ht_covariances(s, [F.col("crop"), F.col("size")])[1][0, 0] == pytest.approx(v)


def test_local_pivotal_spreads_and_keeps_probabilities():
    x = np.array([(i, j) for i in range(8) for j in range(8)], float)
    p = np.full(64, 0.25)
    counts, touching = np.zeros(64), 0
    for seed in range(200):
        chosen = local_pivotal(x, p, seed)
        assert chosen.sum() == 16
        counts += chosen
        own = x[chosen]
        touching += sum(1 for i in range(16) for j in range(i) if abs(own[i] - own[j]).sum() == 1)
    assert abs(counts / 200 - 0.25).max() < 0.13 and touching / 200 < 8


def test_cube_balances():
    x = np.array([(i, j) for i in range(12) for j in range(12)], float)
    p = np.full(144, 0.25)
    off = [abs((x[cube(np.column_stack([p, x]), p, s)] / 0.25).sum(0) - x.sum(0)) for s in range(15)]
    srs = [abs((x[np.random.default_rng(s).choice(144, 36, False)] / 0.25).sum(0) - x.sum(0)) for s in range(15)]
    assert np.mean(off) < 0.5 * np.mean(srs)
    assert all(cube(np.column_stack([p, x]), p, s).sum() == 36 for s in range(15))


def test_neighbours_with_ties():
    x = np.array([(0, 0), (1, 0), (-1, 0), (0, 5)], float)
    assert sorted(neighbours(x, 1)[0].tolist()) == [1, 2]
    r = np.random.default_rng(1).uniform(size=(200, 3))
    for i, near in enumerate(neighbours(r, 4)[:40]):
        d = ((r - r[i]) ** 2).sum(1)
        d[i] = np.inf
        assert set(near) == set(np.argsort(d)[:4])


def test_lowest_and_running_total(spark):
    df = spark.range(1000).select(F.col("id").alias("unit"), (F.col("id") % 3).alias("g"), ((F.col("id") * 7919 % 1000 + 0.5) / 1000).alias("u"), F.lit(10).alias("n"), F.lit(334).alias("c"))
    got = lowest(df, ["g"], "u", "unit", "n", "c").where("chosen").toPandas()
    want = df.toPandas().sort_values("u").groupby("g").head(10)
    assert set(got.unit) == set(want.unit)
    total = running_total(df, ["g"], ["u", "unit"], F.floor(F.col("u") * 16), "unit", "t").toPandas().sort_values(["g", "u"])
    assert (total.t == total.groupby("g").unit.cumsum()).all()
    assert sorted(r.i for r in with_index(df.repartition(5), "i").collect()) == list(range(1, 1001))


def test_points_and_hits(spark, grid):
    s = select_units(grid, 10, method="srs", seed=1)
    p = select_points(s, 9, 1.0, "systematic").toPandas()
    assert len(p) == 90 and p.groupby("unit").apply(lambda g: g.x.round(6).nunique(), include_groups=False).eq(3).all()
    land = grid.select(F.lit("e").alias("establishment"), "unit", F.lit(0.6).alias("area"))
    assert expected_hits(land, s, 9, 1.0).first()["expected_hits"] == pytest.approx(100 * 0.1 * 9 * 0.6)


def test_overlap(spark):
    cells = spark.createDataFrame([(f"c{5 * j + i + 1}", float(i + 1), float(j + 1)) for j in range(5) for i in range(5)], "unit string, x double, y double")
    farms = spark.createDataFrame([("f1", 1.2, 1.1), ("f2", 3.4, 2.6), ("f3", 9.0, 9.0), ("f4", 2.49, 1.5)], "unit string, x double, y double")
    found = {r.unit: (r.cell, r.domain) for r in frame_overlap(farms, cells).list.collect()}
    assert found["f1"] == ("c1", "ab") and found["f2"] == ("c13", "ab") and found["f3"] == (None, "b") and found["f4"][0] in ("c2", "c7")
    pairs = spark.createDataFrame([("f3", "c25")], "unit string, cell string")
    assert {r.unit: r.cell for r in frame_overlap(farms, cells, pairs=pairs).list.collect()}["f3"] == "c25"


def test_segments(spark, grid):
    s = select_units(grid, 25, method="srs", seed=1)
    units = [r.unit for r in s.sampled().orderBy("unit").limit(2).collect()]
    tracts = spark.createDataFrame([(units[0], "e", 100.0, 250.0, True, 0.4), (units[1], "e", 150.0, 250.0, False, 0.6)], "unit string, establishment string, y_tract double, y_total double, headquarters boolean, share double")
    assert [segment_estimator(tracts, s, k).first()["total"] for k in ("closed", "open", "weighted")] == [1000, 1000, 1000]
    lost = tracts.withColumn("unit", F.lit("nowhere"))
    with pytest.raises(ValueError, match="not sampled"):
        segment_estimator(lost, s)


@pytest.mark.parametrize(("method", "options"), [("lpm", {}), ("lpm", {"size": "size"}), ("cube", {"size": "size", "balance": ["x", "crop"]})])
def test_draws_in_blocks(grid, monkeypatch, method, options):
    from terrasample.operators import select

    monkeypatch.setattr(select, "BLOCK", 12)
    s = select_units(grid, 30, method=method, strata="h", seed=4, **options)
    again = select_units(grid.repartition(3), 30, method=method, strata="h", seed=4, **options)
    assert {r.unit for r in s.sampled().collect()} == {r.unit for r in again.sampled().collect()}
    by = {r.h: r for r in s.df.groupBy("h").agg(F.count(F.when(F.col("sampled"), 1)).alias("n"), F.sum("pi").alias("e")).collect()}
    assert all(r.n == pytest.approx(r.e) for r in by.values()) and sum(r.n for r in by.values()) == 30
    if method == "cube":  # the sums are kept but for the landing of a few units
        e = s.df.agg(F.sum(F.when(F.col("sampled"), F.col("x") / F.col("pi"))), F.sum("x")).first()
        assert e[0] == pytest.approx(e[1], rel=0.25)


def test_flights_leave_few_open():
    r = np.random.default_rng(0)
    x, p = r.random((300, 2)), r.uniform(0.05, 0.6, 300)
    p *= 70 / p.sum()
    a = spatial.pivotal_flight(x, p, 1)
    assert ((a > 0) & (a < 1)).sum() <= 1 and a.sum() == pytest.approx(70)
    balance = np.column_stack([p, x * p[:, :1] if p.ndim > 1 else x * p[:, None]])
    c = spatial.cube_flight(balance, p, 1)
    assert ((c > 0) & (c < 1)).sum() <= 3 and np.allclose(balance.T @ (c / p), balance.sum(0))
    hits = sum(spatial.local_pivotal(x, p, s) for s in range(300)) / 300
    assert abs(hits - p).max() < 0.13


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_nearest_sampled_by_cells(dim):
    r = np.random.default_rng(dim)
    sample = np.concatenate([r.random((2500, dim)), r.normal(30, 0.01, (200, dim)), np.repeat(r.random((50, dim)), 2, axis=0)])
    frame = np.concatenate([r.random((400, dim)) * 1.2, r.random((200, dim)) * 40, sample[:50]])
    for a, b in zip(spatial.nearest_sampled(frame, sample), spatial._by_distance(frame, sample), strict=True):
        assert np.allclose(a, b)
