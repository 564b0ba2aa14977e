"""The registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = ["frame_summary", "pps_pi", "srs_sample", "systematic_replicates", "points_random", "design_variance", "local_mean_variance_k3", "point_estimator", "segment_open", "fuller_burmeister", "spatial_balance", "frame_overlap_list", "svyby", "route_summary", "neyman_variance", "moran_i", "coverage_table", "travel_ratio"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return round(float(v), 4) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == names
    got = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr)
    rows = want.fetchall()
    at = [want.columns.index(c) for c in names]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in rows), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
