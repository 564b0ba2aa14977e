"""Routes of several strata that share a number: the registered SQL, unchanged, on one thread has the query's rows; on more its
ORDER BY leaves the order of equal stops open, and only routes of one stratum can be compared."""

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Five strata of 640 sampled units, too many for one vector of DuckDB's."""
    path = tmp_path_factory.mktemp("strata")
    spark.range(80000).selectExpr("id AS c_custkey", "concat('S', id % 5) AS c_mktsegment", "CAST(id % 25 AS INT) AS c_nationkey", "CAST(id % 997 AS DOUBLE) AS c_acctbal").write.parquet(f"{path}/customer.parquet")
    return str(path)


def compared(spark, sf, name):
    """Rows of the query and of its SQL with one thread and with eight."""
    df = entry.queries()[name](spark, sf)
    out = [[tuple(r) for r in df.collect()]]
    for threads in (1, 8):
        c = duckdb.connect(config={"threads": threads})
        c.sql(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{sf}/customer.parquet/*.parquet')")
        out.append(c.sql(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall())
    return [sorted(rows) for rows in out]


def flat(rows):
    return [v for r in rows for v in r]


def test_cost_of(spark, sf):
    mine, one, many = compared(spark, sf, "cost_of")
    assert flat(mine) == pytest.approx(flat(one))
    assert mine[0][1:4] == many[0][1:4]  # travel depends on the order of equal stops


def of_one_stratum(rows):
    """Strata number their routes from 100, 200 and so on: 640 units have 107 routes, and the first seven of a stratum but the
    first are the last of the one before."""
    return [r for r in rows if r[0] < 200 or r[0] >= 600 or r[0] % 100 >= 7]


def same_rows(spark, sf, name):
    mine, one, many = compared(spark, sf, name)
    assert flat(mine) == pytest.approx(flat(one)) and len(of_one_stratum(mine)) < len(mine)
    assert flat(of_one_stratum(mine)) == pytest.approx(flat(of_one_stratum(many)))


def test_route_segments(spark, sf):
    same_rows(spark, sf, "route_segments")


def test_route_summary(spark, sf):
    same_rows(spark, sf, "route_summary")


def test_route_legs(spark, sf):
    same_rows(spark, sf, "route_legs")
