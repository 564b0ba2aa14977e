import json
import re
import struct

import pytest
from pyspark.sql import functions as F

from terrasample.functions.columns import haversine
from terrasample.operators.travel import travel_matrix
from terrasample.sources.areaframe import area_frame, as_frame, as_geometries, read_areaframe
from terrasample.sources.osrm import osrm_table
from terrasample.sources.resume import run_missing


def polygon(ring):
    return struct.pack("<BII", 1, 3, 1) + struct.pack("<I", len(ring)) + b"".join(struct.pack("<dd", *p) for p in ring)


def test_area_frame_reads_parquet(spark, tmp_path):
    rows = [(1, -35.0, -8.0, 2e6, polygon([(0, 0), (1, 0), (1, 1), (0, 0)]), 5.0)]
    path = str(tmp_path / "frame.parquet")
    spark.createDataFrame(rows, "cell_index int, centroid_lon double, centroid_lat double, area_m2 double, geom_wkb binary, crop double").write.parquet(path)
    f = read_areaframe(spark, path)
    assert f.columns == ["unit", "lat", "lon", "area", "crop"] and f.first().asDict() == {"unit": "c1", "lat": -8.0, "lon": -35.0, "area": 2.0, "crop": 5.0}
    assert "geom_wkb" in read_areaframe(spark, path, geometry=True).columns
    with pytest.raises(ValueError, match="cell_index"):
        area_frame(spark.range(1))


def test_wkb_and_geojson(spark, tmp_path):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    df = spark.createDataFrame([("p", polygon(ring))], "name string, geom_wkb binary")
    r = as_frame(df, "name").first()
    assert r["lon"] == pytest.approx(0.5) and r["lat"] == pytest.approx(0.5, abs=1e-3) and r["area"] == pytest.approx(12364, rel=2e-3)
    path = tmp_path / "f.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"crop": 3}, "geometry": {"type": "Point", "coordinates": [-35.0, -8.0]}}]}))
    g = read_areaframe(spark, str(path)).first()
    assert (g["lat"], g["lon"], g["crop"], g["unit"]) == (-8.0, -35.0, 3, "u1")
    shapes = spark.createDataFrame([("u1", b"x")], "unit string, geom_wkb binary")
    assert as_geometries(spark.createDataFrame([("u1", 2.0)], "unit string, pi double"), shapes).first()["geom_wkb"] == b"x"
    with pytest.raises(ValueError, match="geometry"):
        as_geometries(spark.createDataFrame([("u2", 2.0)], "unit string, pi double"), shapes)


def test_haversine(spark):
    row = spark.range(1).select(haversine(F.lit(-8.05), F.lit(-34.90), F.lit(-8.10), F.lit(-34.95)).alias("d")).first()
    assert row["d"] == pytest.approx(7.82, rel=0.01)


def test_osrm_blocks(spark):
    pts = spark.createDataFrame([(f"u{i}", -8 - i / 100, -35 + i / 100) for i in range(1, 8)], "unit string, lat double, lon double")

    def fake(url):
        place = [tuple(map(float, p.split(","))) for p in re.search(r"driving/([^?]*)", url)[1].split(";")]
        index = [round((p[0] + 35) * 100) for p in place]
        a, b = (list(map(int, re.search(rf"{k}=([\d;]+)", url)[1].split(";"))) for k in ("sources", "destinations"))
        return {"code": "Ok", "durations": [[abs(index[i] - index[j]) * 600 for j in b] for i in a], "sources": [{"distance": index[i] / 10} for i in a]}

    m, snap = osrm_table(pts, block=3, fetch=fake)
    got = {(r["from"], r["to"]): r["travel"] for r in m.df.collect()}
    assert len(got) == 49 and got["u1", "u7"] == 60 and got["u3", "u3"] == 0
    assert {r.unit: r.snap for r in snap.collect()}["u7"] == pytest.approx(0.7)

    def broken(url):
        out = fake(url)
        out["durations"][0][0] = None
        return out

    with pytest.raises(ValueError, match="cannot reach"):
        osrm_table(pts, block=7, fetch=broken)


def test_travel_matrix(spark):
    p = spark.createDataFrame([("a", 0.0, 0.0), ("b", 3.0, 4.0)], "unit string, x double, y double")
    assert {(r["from"], r["to"]): r["travel"] for r in travel_matrix(p).df.collect()}["a", "b"] == 5
    assert travel_matrix(p, speed=60).square(["a", "b"])[0, 1] == 5
    with pytest.raises(ValueError, match="detour"):
        travel_matrix(p, detour=0.5)


def test_resume(spark, tmp_path):
    path, done = str(tmp_path / "out"), []

    def work(df):
        done.append(df.count())
        return df.withColumn("y", F.col("k") * 2)

    tasks = spark.range(5).withColumnRenamed("id", "k")
    run_missing(spark, tasks.where("k < 3"), "k", path, work)
    assert run_missing(spark, tasks, "k", path, work).count() == 5 and done == [3, 2]


def test_geojson_lines_and_missing_geometries(spark, tmp_path):
    from terrasample.sources.areaframe import read_geojson

    features = [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [2.0, 1.0]}, "properties": {"unit": "a", "v": 5}},
        {"type": "Feature", "geometry": None, "properties": {"unit": "b", "v": 6}},
    ]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, features)))
    (tmp_path / "all.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    for path, lines in (("lines.json", True), ("all.json", False)):
        got = {r.unit: (r.lat, r.lon, r.v) for r in read_geojson(spark, f"file://{tmp_path}/{path}", lines).collect()}
        assert got == {"a": (1.0, 2.0, 5), "b": (None, None, 6)}
