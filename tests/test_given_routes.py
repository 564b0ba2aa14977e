"""Given routes: only their legs are priced, and stops that share numbers keep the order of their strata."""

import duckdb
import pytest

import __spark_entry__ as entry
from terrasample.operators.routing import legs, route_segments
from terrasample.operators.travel import travel_matrix


def customers(spark, path, each):
    """Customers from key 0 on, ``each`` in two strata."""
    columns = ["id AS c_custkey", "IF(id % 2 = 0, 'A', 'B') AS c_mktsegment", "CAST(id % 25 AS INT) AS c_nationkey", "CAST(id % 997 AS DOUBLE) AS c_acctbal"]
    spark.range(2 * each).selectExpr(*columns).write.parquet(f"{path}/customer.parquet")
    return str(path)


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory):
    """620 sampled units a stratum: routes 200 to 203 are of both."""
    return customers(spark, tmp_path_factory.mktemp("shared"), 15500)


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    """60 of 62 customers are sampled, the one with key 0 too."""
    return customers(spark, tmp_path_factory.mktemp("tiny"), 31)


def flat(rows):
    return [v for row in sorted(rows) for v in row]


def same(spark, sf, name, ties=False):
    """The query gives the rows of its SQL, or of its SQL with the stratum's number as a last key of its ORDER BY."""
    sql = entry.oracle_sql()[name]
    if ties:
        sql = sql.replace("PARTITION BY route ORDER BY stop)", "PARTITION BY route ORDER BY stop, g)").replace("AS stop, unit, x, y FROM numbered", "AS stop, unit, g, x, y FROM numbered")
    df = entry.queries()[name](spark, sf)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{sf}/customer.parquet/*.parquet')")
    want = c.sql(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
    assert flat(map(tuple, df.collect())) == pytest.approx(flat(want))
    return "Join Cross" in df._jdf.queryExecution().optimizedPlan().toString()


def test_cost_of(spark, shared, tiny):
    assert not same(spark, shared, "cost_of", ties=True)
    assert not same(spark, tiny, "cost_of")


def test_route_segments(spark, shared, tiny):
    same(spark, shared, "route_segments", ties=True)
    same(spark, tiny, "route_segments")
    stops = spark.createDataFrame([(1, 1, "b", "d", 2), (1, 1, "a", "d", 1)], "route int, stop int, unit string, depot string, g int").coalesce(1)
    units = spark.createDataFrame([("d", 0.0, 0.0), ("a", 1.0, 0.0), ("b", 2.0, 0.0)], "unit string, x double, y double")
    assert sorted((r.stop, r.x, r.xend) for r in route_segments(stops, units, ("x", "y"), ties=("g",)).collect()) == [(1, 0.0, 1.0), (1, 1.0, 2.0), (2, 2.0, 0.0)]


def test_route_legs(spark, shared, tiny):
    assert not same(spark, shared, "route_legs", ties=True)
    assert not same(spark, tiny, "route_legs")
    points = spark.createDataFrame([("d", 0.0, 0.0), ("a", 3.0, 4.0)], "unit string, x double, y double")
    stops = spark.createDataFrame([(1, 1, "a", "d"), (1, 2, "z", "d")], "route int, stop int, unit string, depot string")
    m = travel_matrix(points, "euclidean", speed=30, coords=["x", "y"])
    for given in (m, m.df):
        assert [(r.unit, r.leg) for r in legs(stops, given).orderBy("stop").collect()] == [("a", 10.0), ("z", None)]


def test_route_summary(spark, shared, tiny):
    assert not same(spark, shared, "route_summary", ties=True)
    assert not same(spark, tiny, "route_summary")
