"""Survey tables derived from the shared test tables, as DataFrames and as SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasample.operators.select import Sample, select_units

SEED, REPLICATES = 1, 4
#: Sampled cells: a share of the frame, and at least so many.
SHARE_SRS, LEAST_SRS, SHARE_SYS, LEAST_SYS = 25, 60, 40, 40
N_SRS = f"(SELECT greatest({LEAST_SRS}, count(*) // {SHARE_SRS}) FROM cells)"
N_SYS = f"(SELECT greatest({LEAST_SYS}, count(*) // {SHARE_SYS}) FROM cells)"


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as cells of a grid 40 wide."""
    c = read(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("unit"), (F.col("c_custkey") % 40).alias("x"), F.floor(F.col("c_custkey") / 40).alias("y"), F.col("c_mktsegment").alias("stratum"),
        F.col("c_acctbal").alias("v"), ((1 + F.col("c_nationkey")) * (1 + F.col("c_nationkey"))).cast("double").alias("size"), F.col("c_nationkey").alias("nation"),
    )


CELLS = """cells AS (SELECT c_custkey AS unit, c_custkey % 40 AS x, CAST(floor(c_custkey / 40.0) AS BIGINT) AS y, c_mktsegment AS stratum, c_acctbal AS v,
  CAST((1 + c_nationkey) * (1 + c_nationkey) AS DOUBLE) AS size, c_nationkey AS nation FROM customer)"""


def n_srs(c: DataFrame) -> int:
    return max(LEAST_SRS, c.count() // SHARE_SRS)


def srs(spark: SparkSession, sf: str) -> Sample:
    c = cells(spark, sf)
    return select_units(c, n_srs(c), strata="stratum", method="srs", seed=SEED)


ALLOC = f"""levels AS (SELECT stratum, count(*) AS big, row_number() OVER (ORDER BY stratum) AS k FROM cells GROUP BY stratum),
shares AS (SELECT *, {N_SRS}::DOUBLE * big / sum(big) OVER () AS share FROM levels),
ranked AS (SELECT *, row_number() OVER (ORDER BY share - floor(share) DESC, k) AS place, {N_SRS} - sum(floor(share)) OVER () AS spare FROM shares),
alloc AS (SELECT stratum, k, big, CAST(floor(share) + CASE WHEN place <= spare THEN 1 ELSE 0 END AS BIGINT) AS n FROM ranked)"""

SRS = f"""{CELLS}, {ALLOC},
drawn AS (SELECT c.*, a.n, a.big, row_number() OVER (PARTITION BY c.stratum ORDER BY substr(md5((100 * {SEED} + a.k) || ':' || c.unit), 1, 13), c.unit) AS place FROM cells c JOIN alloc a USING (stratum)),
sample AS (SELECT *, place <= n AS sampled, n::DOUBLE / big AS pi FROM drawn)"""


def systematic(spark: SparkSession, sf: str, replicates: int = 1) -> Sample:
    c = cells(spark, sf)
    return select_units(c, max(LEAST_SYS, c.count() // SHARE_SYS), size="size", coords=["x", "y"], method="systematic", replicates=replicates, seed=SEED)


HILBERT = """grid AS (SELECT unit, CAST(floor((x - (SELECT min(x) FROM cells))::DOUBLE / (SELECT max(x) - min(x) FROM cells) * 65535) AS BIGINT) AS hx,
  CAST(floor((y - (SELECT min(y) FROM cells))::DOUBLE / (SELECT max(y) - min(y) FROM cells) * 65535) AS BIGINT) AS hy FROM cells),
walk AS (SELECT unit, hx, hy, 0::BIGINT AS d, 32768::BIGINT AS s FROM grid UNION ALL
  SELECT unit, CASE WHEN ry = 0 THEN (CASE WHEN rx = 1 THEN s - 1 - (hy & (s - 1)) ELSE hy & (s - 1) END) ELSE hx & (s - 1) END,
         CASE WHEN ry = 0 THEN (CASE WHEN rx = 1 THEN s - 1 - (hx & (s - 1)) ELSE hx & (s - 1) END) ELSE hy & (s - 1) END,
         d + s * s * xor(3 * rx, ry), s // 2
  FROM (SELECT *, CASE WHEN hx & s > 0 THEN 1 ELSE 0 END AS rx, CASE WHEN hy & s > 0 THEN 1 ELSE 0 END AS ry FROM walk WHERE s > 0)),
curve AS (SELECT unit, d AS h FROM walk WHERE s = 0)"""

PPS = """biggest AS (SELECT unit, size, g, n, row_number() OVER (PARTITION BY g ORDER BY size DESC, unit) AS r,
  sum(size) OVER (PARTITION BY g ORDER BY size DESC, unit ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM wanted),
flagged AS (SELECT *, bool_and((n - r + 1) * size >= rest) OVER (PARTITION BY g ORDER BY r) AS certain FROM biggest),
tail AS (SELECT g, count(*) FILTER (WHERE certain) AS k, coalesce(sum(size) FILTER (WHERE NOT certain), 0) AS left_size FROM flagged GROUP BY g),
pps AS (SELECT unit, g, CASE WHEN certain THEN 1.0::DOUBLE ELSE (n - k) * size / left_size END AS p FROM flagged JOIN tail USING (g))"""


def systematic_sql(replicates: int = 1) -> str:
    picks = ", ".join(f"floor(round(c, 9) - {_start(k)}) > floor(round(c - q, 9) - {_start(k)}) AS in{k}" for k in range(replicates))
    hit = " OR ".join(f"in{k}" for k in range(replicates))
    pi = "q" if replicates == 1 else f"1 - pow(1 - q, {replicates})"
    return f"""RECURSIVE {CELLS}, {HILBERT}, wanted AS (SELECT unit, size, 0 AS g, {N_SYS} AS n FROM cells), {PPS},
summed AS (SELECT c.*, p.p / {replicates} AS q, sum(p.p / {replicates}) OVER (ORDER BY h.h, c.unit ROWS UNBOUNDED PRECEDING) AS c FROM cells c JOIN curve h USING (unit) JOIN pps p USING (unit)),
picked AS (SELECT *, {picks} FROM summed),
sample AS (SELECT *, {hit} AS sampled, {pi} AS pi FROM picked)"""


def _start(k: int) -> str:
    return f"((CAST(('0x' || substr(md5('{100 * SEED + 1}:{k}'), 1, 16)) AS UBIGINT) % 4503599627370496 + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def areas(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as establishments with land in the cells of the customers they serve."""
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    both = lines.join(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    q = both.groupBy(F.col("l_suppkey").alias("establishment"), F.col("o_custkey").alias("unit")).agg(F.sum("l_quantity").alias("q"))
    whole = q.groupBy("unit").agg(F.sum("q").alias("whole"))
    return q.join(whole, "unit").select("establishment", "unit", (F.col("q") / (1 + F.col("whole"))).alias("area"))


AREAS = """land AS (SELECT l_suppkey AS establishment, o_custkey AS unit, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
areas AS (SELECT establishment, unit, q / (1 + sum(q) OVER (PARTITION BY unit)) AS area FROM land)"""


def tracts(spark: SparkSession, sf: str) -> DataFrame:
    """What each establishment makes in a cell, in all, and whether the cell has its headquarters (its nation's)."""
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    both = lines.join(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    t = both.groupBy(F.col("l_suppkey").alias("establishment"), F.col("o_custkey").alias("unit")).agg(F.sum("l_extendedprice").alias("y_tract"))
    total = t.groupBy("establishment").agg(F.sum("y_tract").alias("y_total"))
    nation = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("establishment"), "s_nationkey")
    home = read(spark, sf, "customer").select(F.col("c_custkey").alias("unit"), "c_nationkey")
    rows = t.join(total, "establishment").join(nation, "establishment").join(home, "unit")
    return rows.select("unit", "establishment", "y_tract", "y_total", (F.col("s_nationkey") == F.col("c_nationkey")).alias("headquarters"), (F.col("y_tract") / F.col("y_total")).alias("share"))


TRACTS = """made AS (SELECT l_suppkey AS establishment, o_custkey AS unit, sum(l_extendedprice) AS y_tract FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
totals AS (SELECT establishment, sum(y_tract) AS y_total FROM made GROUP BY 1),
tracts AS (SELECT m.unit, m.establishment, y_tract, y_total, s_nationkey = c_nationkey AS headquarters, y_tract / y_total AS share
  FROM made m JOIN totals USING (establishment) JOIN supplier ON s_suppkey = m.establishment JOIN customer ON c_custkey = m.unit)"""


def listed(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as a list frame with places, some beyond the grid."""
    k = F.col("s_suppkey")
    return read(spark, sf, "supplier").select(k.alias("unit"), ((k * 7) % 44 + 0.25).cast("double").alias("x"), ((k * 3) % 38 + 0.25).cast("double").alias("y"), F.col("s_acctbal").alias("v"))


LISTED = "listed AS (SELECT s_suppkey AS unit, (s_suppkey * 7) % 44 + 0.25::DOUBLE AS x, (s_suppkey * 3) % 38 + 0.25::DOUBLE AS y, s_acctbal AS v FROM supplier)"
