"""The registered queries. Each applies operators of this package to the derived tables; its SQL gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasample.operators import allocation, analytics, estimate, points, routing, schedule, travel
from terrasample.operators.costcurve import CostCurve
from terrasample.operators.design import dual_frame_design, two_stage_design
from terrasample.operators.frontier import cost_variance_frontier, routed_cost_curve
from terrasample.operators.overlap import frame_overlap
from terrasample.operators.pointdesign import point_design_effect
from terrasample.operators.select import Sample, inclusion_probabilities, select_units
from terrasample.functions.columns import HILBERT_BITS, hilbert
from terrasample.plans.tables import (
    ALLOC, AREAS, CELLS, HILBERT, LEAST_SRS, LISTED, N_SRS, N_SYS, PPS, REPLICATES, SEED, SRS, TRACTS, areas, cells, listed, n_srs, read, srs, systematic, systematic_sql, tracts,
)
from terrasample.sources import areaframe, survey

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(c: Column | str, digits: int = 4) -> Column:
    return F.round(c, digits)


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


# --- frames and selection -----------------------------------------------------------------------
@query(f"""WITH {CELLS} SELECT stratum, count(*) AS units, sum(size) AS size, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd,
  round(quantile_cont(v, 0.5), 4) AS median, min(v) AS low, max(v) AS high FROM cells GROUP BY stratum""")
def frame_summary(spark, sf):
    by = cells(spark, sf).groupBy("stratum")
    return by.agg(F.count(F.lit(1)).alias("units"), F.sum("size").alias("size"), r(F.avg("v")).alias("mean"), r(F.stddev_samp("v")).alias("sd"), r(F.percentile("v", 0.5)).alias("median"), F.min("v").alias("low"), F.max("v").alias("high"))


@query("SELECT 'c' || c_custkey AS unit, c_custkey % 40 * 0.01 - 8 AS lat, c_custkey % 7 * 0.01 - 35 AS lon, (1 + c_nationkey) * 250000.0::DOUBLE / 1e6 AS area, c_mktsegment AS segment FROM customer")
def read_cells(spark, sf):
    c = read(spark, sf, "customer")
    exported = c.select(
        F.col("c_custkey").alias("cell_index"), (F.col("c_custkey") % 40 * F.lit(0.01) - 8).alias("centroid_lat"), (F.col("c_custkey") % 7 * F.lit(0.01) - 35).alias("centroid_lon"),
        ((1 + F.col("c_nationkey")) * F.lit(250000.0)).alias("area_m2"), F.col("c_mktsegment").alias("segment"),
    )
    return areaframe.area_frame(exported)


@query(f"WITH {CELLS}, wanted AS (SELECT unit, size, 0 AS g, (SELECT count(*) // 2 FROM cells) AS n FROM cells), {PPS} SELECT unit, round(p, 9) AS pi FROM pps")
def pps_pi(spark, sf):
    c = cells(spark, sf)
    return inclusion_probabilities(c, c.count() // 2, "size").select("unit", r("pi", 9).alias("pi"))


@query(f"WITH {CELLS}, wanted AS (SELECT unit, size, stratum AS g, count(*) OVER (PARTITION BY stratum) // 2 AS n FROM cells), {PPS} SELECT unit, round(p, 9) AS pi FROM pps")
def pps_pi_stratified(spark, sf):
    c = cells(spark, sf)
    n = {x["stratum"]: x["count"] // 2 for x in c.groupBy("stratum").count().collect()}
    return inclusion_probabilities(c, n, "size", "stratum").select("unit", r("pi", 9).alias("pi"))


@query(f"WITH {CELLS}, {ALLOC} SELECT stratum, n FROM alloc")
def alloc_largest_remainder(spark, sf):
    return spark.createDataFrame(list(srs(spark, sf).design.n.items()), "stratum string, n long")


@query(f"WITH {SRS} SELECT unit, stratum, round(pi, 9) AS pi FROM sample WHERE sampled")
def srs_sample(spark, sf):
    return srs(spark, sf).sampled().select("unit", "stratum", r("pi", 9).alias("pi"))


@query(f"WITH RECURSIVE {CELLS}, {HILBERT} SELECT unit, h FROM curve")
def hilbert_index(spark, sf):
    c = cells(spark, sf)
    e = c.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    top = (1 << HILBERT_BITS) - 1
    cell = [F.floor((F.col(k).cast("double") - lo) / float(hi - lo) * top).cast("long") for k, lo, hi in (("x", e[0], e[1]), ("y", e[2], e[3]))]
    return c.select("unit", hilbert(*cell).alias("h"))


@query(f"WITH {systematic_sql()} SELECT unit, round(pi, 9) AS pi FROM sample WHERE sampled")
def systematic_sample(spark, sf):
    return systematic(spark, sf).sampled().select("unit", r("pi", 9).alias("pi"))


_REPS = " + ".join(f"in{k}::INT" for k in range(REPLICATES))


@query(f"WITH {systematic_sql(REPLICATES)} SELECT unit, round(pi, 9) AS pi, round(q, 9) AS pi_replicate, {_REPS} AS n_replicates FROM sample WHERE sampled")
def systematic_replicates(spark, sf):
    return systematic(spark, sf, REPLICATES).sampled().select("unit", r("pi", 9).alias("pi"), r("pi_replicate", 9).alias("pi_replicate"), "n_replicates")


def _drawn(spark, sf, method: str, **options) -> DataFrame:
    """By stratum: the sample's size, the sum of all probabilities, and the estimated total of the size that they are
    proportional to, which is exact in every sample of fixed size."""
    c = cells(spark, sf)
    s = select_units(c, n_srs(c), size="size", coords=["x", "y"], strata="stratum", method=method, seed=SEED_LPM, **options)
    own = F.when(F.col("sampled"), F.col("size") / F.col("pi"))
    return s.df.groupBy("stratum").agg(F.count(F.when(F.col("sampled"), 1)).alias("n"), r(F.sum("pi"), 6).alias("expected"), r(F.sum(own), 3).alias("size"))


_DRAWN = f"""WITH {CELLS}, {ALLOC.replace("count(*) AS big", "sum(size) AS big")} SELECT stratum, n, n::DOUBLE AS expected, round(big, 3) AS size FROM alloc"""


@query(_DRAWN)
def lpm_sample(spark, sf):
    return _drawn(spark, sf, "lpm")


@query(_DRAWN)
def cube_sample(spark, sf):
    return _drawn(spark, sf, "cube", balance=["x", "v"])


SEED_LPM = 7
_U = "(CAST(('0x' || substr(md5({}), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE"


@query(f"""WITH {SRS} SELECT unit, point::INT AS point, round(x + ({_U.format("'1:' || unit || ':' || point || ':a'")} - 0.5) * 1.0, 6) AS x,
  round(y + ({_U.format("'1:' || unit || ':' || point || ':b'")} - 0.5) * 1.0, 6) AS y, round(pi * 6, 9) AS density FROM sample, range(1, 7) p(point) WHERE sampled""")
def points_random(spark, sf):
    p = points.select_points(srs(spark, sf), 6, 1.0, "random", 1)
    return p.select("unit", "point", r("x", 6).alias("x"), r("y", 6).alias("y"), r("density", 9).alias("density"))


@query(f"""WITH {SRS} SELECT unit, point::INT AS point, round(x + (((point - 1) % 2 + {_U.format("'1:' || unit || ':a'")}) / 2 - 0.5) * 1.0, 6) AS x,
  round(y + (((point - 1) // 2 + {_U.format("'1:' || unit || ':b'")}) / 3 - 0.5) * 1.0, 6) AS y FROM sample, range(1, 7) p(point) WHERE sampled""")
def points_systematic(spark, sf):
    p = points.select_points(srs(spark, sf), 6, 1.0, "systematic", 1)
    return p.select("unit", "point", r("x", 6).alias("x"), r("y", 6).alias("y"))


# --- estimators -----------------------------------------------------------------------------------
def _estimate(df: DataFrame, *more: str) -> DataFrame:
    return df.select(r("total", 2).alias("total"), r("se", 3).alias("se"), r(F.sqrt("variance_srs"), 3).alias("se_srs"), "n", "n_frame", *more)


_STRATIFIED = """strata AS (SELECT stratum, count(*) FILTER (WHERE sampled) AS n, count(*) AS big, var_samp(z) FILTER (WHERE sampled) AS s2 FROM valued GROUP BY stratum),
variance AS (SELECT sum(big * big * (1 - n::DOUBLE / big) * s2 / n) AS v FROM strata),
overall AS (SELECT sum(z / pi) FILTER (WHERE sampled) AS total, count(*) FILTER (WHERE sampled) AS n, count(*) AS big, var_samp(z) FILTER (WHERE sampled) AS s2 FROM valued)"""
_RESULT = "round(total, 2) AS total, round(sqrt(v), 3) AS se, round(sqrt(big * big * (1 - n::DOUBLE / big) * s2 / n), 3) AS se_srs, n, big AS n_frame"


@query(f"WITH {SRS} SELECT round(sum(v / pi) FILTER (WHERE sampled), 2) AS total FROM sample")
def ht_total(spark, sf):
    return estimate.ht_total(srs(spark, sf).df, F.col("v")).select(r("total", 2).alias("total"))


@query(f"WITH {SRS} SELECT stratum, round(max(big) * max(big) * (1 - count(*)::DOUBLE / max(big)) * var_samp(v) / count(*), 0) AS variance FROM sample WHERE sampled GROUP BY stratum")
def srs_variance(spark, sf):
    s = srs(spark, sf)
    by = s.df.groupBy("stratum").agg(F.count(F.when(F.col("sampled"), 1)).alias("n"), F.count(F.lit(1)).alias("n_frame"), F.var_samp(F.when(F.col("sampled"), F.col("v"))).alias("s2"))
    return by.select("stratum", r(estimate.srs_variance(F.col("n"), F.col("n_frame"), F.col("s2")), 0).alias("variance"))


@query(f"WITH {SRS}, valued AS (SELECT *, v AS z FROM sample), {_STRATIFIED} SELECT {_RESULT}, 'stratified srs' AS variance_method, n - 5 AS df FROM overall, variance")
def design_variance(spark, sf):
    return _estimate(estimate.design_variance(srs(spark, sf), "v"), "variance_method", "df")


@query(f"""WITH {systematic_sql(REPLICATES)},
each AS ({" UNION ALL ".join(f"SELECT sum(v / q) FILTER (WHERE in{k}) AS e FROM sample" for k in range(REPLICATES))})
SELECT round(avg(e), 2) AS total, round(sqrt(var_samp(e) / {REPLICATES}), 3) AS se, {REPLICATES - 1} AS df FROM each""")
def replicate_variance(spark, sf):
    return estimate.design_variance(systematic(spark, sf, REPLICATES), "v").select(r("total", 2).alias("total"), r("se", 3).alias("se"), "df")


def _local_mean_sql(k: int) -> str:
    return f"""WITH {systematic_sql()}, own AS (SELECT unit, x, y, v / pi AS e FROM sample WHERE sampled),
near AS (SELECT a.unit, b.e, rank() OVER (PARTITION BY a.unit ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS place FROM own a JOIN own b ON a.unit <> b.unit),
grouped AS (SELECT unit, e FROM near WHERE place <= {k} UNION ALL SELECT unit, e FROM own),
means AS (SELECT unit, count(*) AS m, avg(e) AS mean FROM grouped GROUP BY unit),
parts AS (SELECT sum(m::DOUBLE / (m - 1) * (e - mean) * (e - mean)) AS v FROM own JOIN means USING (unit))
SELECT round((SELECT sum(e) FROM own), 2) AS total, round(sqrt(v), 3) AS se FROM parts"""


def _local_mean(k: int):
    def run(spark, sf):
        return estimate.design_variance(systematic(spark, sf), "v", neighbours=k).select(r("total", 2).alias("total"), r("se", 3).alias("se"))

    run.__name__ = f"local_mean_variance_k{k}"
    return query(_local_mean_sql(k))(run)


for _k in (1, 3, 5):
    _local_mean(_k)


@query(f"""WITH {SRS}, sums AS (SELECT sum(v / pi) AS ys, sum(size / pi) AS xs, (SELECT sum(size) FROM sample) AS known FROM sample WHERE sampled),
valued AS (SELECT s.*, v - ys / xs * size AS z FROM sample s, sums), {_STRATIFIED}
SELECT round(known * ys / xs, 2) AS total, round(known / xs * sqrt(v), 3) AS se, round(ys / xs, 6) AS ratio FROM sums, overall, variance""")
def ratio_estimator(spark, sf):
    return estimate.ratio_estimator(srs(spark, sf), "v", "size").select(r("total", 2).alias("total"), r("se", 3).alias("se"), r("ratio", 6).alias("ratio"))


@query(f"WITH {SRS}, {AREAS} SELECT establishment, round(sum(pi * 6 * area), 6) AS expected_hits FROM areas JOIN sample USING (unit) GROUP BY establishment")
def expected_hits(spark, sf):
    return rounded(points.expected_hits(areas(spark, sf), srs(spark, sf), 6, 1.0), expected_hits=6)


def _hits(spark, sf) -> tuple[DataFrame, Sample]:
    s = srs(spark, sf)
    land = areas(spark, sf)
    expected = points.expected_hits(land, s, 6, 1.0)
    value = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("establishment"), F.col("s_acctbal").alias("y"))
    found = land.join(s.sampled().select("unit"), "unit").where("area > 0.05")
    return found.join(expected, "establishment").join(value, "establishment").select("unit", "establishment", "y", "expected_hits"), s


@query(f"""WITH {SRS}, {AREAS}, expected AS (SELECT establishment, sum(pi * 6 * area) AS e FROM areas JOIN sample USING (unit) GROUP BY establishment),
hits AS (SELECT a.unit, a.establishment, s_acctbal / e AS c FROM areas a JOIN sample s USING (unit) JOIN expected x ON x.establishment = a.establishment JOIN supplier ON s_suppkey = a.establishment WHERE sampled AND area > 0.05),
valued AS (SELECT s.*, coalesce(u, 0) * pi AS z FROM sample s LEFT JOIN (SELECT unit, sum(c) AS u FROM hits GROUP BY unit) USING (unit)), {_STRATIFIED}
SELECT {_RESULT}, (SELECT count(*) FROM hits) AS n_hits, (SELECT count(DISTINCT establishment) FROM hits) AS n_establishments FROM overall, variance""")
def point_estimator(spark, sf):
    hits, s = _hits(spark, sf)
    return _estimate(estimate.point_estimator(hits, s), "n_hits", "n_establishments")


def _segment(kind: str, value: str):
    sql = f"""WITH {SRS}, {TRACTS}, valued AS (SELECT s.*, coalesce(t.z, 0) AS z FROM sample s LEFT JOIN (SELECT unit, sum({value}) AS z FROM tracts GROUP BY unit) t USING (unit)), {_STRATIFIED}
SELECT round(total, 0) AS total, round(sqrt(v), 0) AS se, n FROM overall, variance"""

    def run(spark, sf):
        s = srs(spark, sf)
        own = tracts(spark, sf).join(s.sampled().select("unit"), "unit", "left_semi")
        return estimate.segment_estimator(own, s, kind).select(r("total", 0).alias("total"), r("se", 0).alias("se"), "n")

    run.__name__ = f"segment_{kind}"
    return query(sql)(run)


_segment("closed", "y_tract")
_segment("open", "CASE WHEN headquarters THEN y_total ELSE 0 END")
_segment("weighted", "y_total * share")


def _dual(spark, sf) -> tuple[Sample, Sample]:
    """Area sample of cells and a list sample of the units overlapping them."""
    a = srs(spark, sf)
    a = Sample(a.df.withColumn("domain", F.when(F.col("nation") % 3 == 0, "ab").otherwise("a")), a.design)
    units = listed(spark, sf).withColumn("domain", F.when(F.col("x") < 30, "ab").otherwise("b"))
    n = max(4, units.count() // 4)
    return a, select_units(units, n, coords=["x", "y"], method="srs", seed=SEED_LIST)


SEED_LIST = 3
_DUAL = f"""{SRS}, {LISTED}, size_b AS (SELECT greatest(4, count(*) // 4) AS n, count(*) AS big FROM listed),
list_drawn AS (SELECT l.*, CASE WHEN x < 30 THEN 'ab' ELSE 'b' END AS domain, row_number() OVER (ORDER BY substr(md5('{100 * SEED_LIST + 1}:' || unit), 1, 13), unit) AS place FROM listed l),
bs AS (SELECT d.*, place <= n AS sampled, n::DOUBLE / big AS pi, 'all' AS stratum FROM list_drawn d, size_b),
sa AS (SELECT *, CASE WHEN nation % 3 = 0 THEN 'ab' ELSE 'a' END AS domain FROM sample),
va AS (SELECT stratum, sampled, pi, CASE WHEN domain = 'a' THEN v ELSE 0 END AS own, CASE WHEN domain = 'ab' THEN v ELSE 0 END AS ab, CASE WHEN domain = 'ab' THEN 1.0 ELSE 0 END AS one FROM sa),
vb AS (SELECT stratum, sampled, pi, CASE WHEN domain = 'b' THEN v ELSE 0 END AS own, CASE WHEN domain = 'ab' THEN v ELSE 0 END AS ab, CASE WHEN domain = 'ab' THEN 1.0 ELSE 0 END AS one FROM bs),"""


def _moments(t: str) -> str:
    pairs = {"vo": ("own", "own"), "vt": ("ab", "ab"), "c": ("own", "ab"), "vn": ("one", "one"), "co": ("own", "one"), "cn": ("ab", "one")}
    cols = ", ".join(f"sum(big * big * (1 - n::DOUBLE / big) / n * {k}) AS {k}" for k in pairs)
    inner = ", ".join(f"covar_samp({a}, {b}) FILTER (WHERE sampled) AS {k}" for k, (a, b) in pairs.items())
    return f"""m{t} AS (SELECT {cols} FROM (SELECT stratum, count(*) FILTER (WHERE sampled) AS n, count(*) AS big, {inner} FROM {t} GROUP BY stratum)),
t{t} AS (SELECT sum(own / pi) AS own, sum(ab / pi) AS ab, sum(one / pi) AS one FROM {t} WHERE sampled)"""


_HARTLEY = f"""WITH {_DUAL} {_moments("va")}, {_moments("vb")},
weight AS (SELECT greatest(0, least(1, (mvb.vt + mvb.c - mva.c) / (mva.vt + mvb.vt))) AS th FROM mva, mvb)
SELECT round(tva.own + th * tva.ab + (1 - th) * tvb.ab + tvb.own, 2) AS total, round(th, 6) AS theta,
  round(sqrt(mva.vo + th * th * mva.vt + 2 * th * mva.c + mvb.vo + (1 - th) * (1 - th) * mvb.vt + 2 * (1 - th) * mvb.c), 3) AS se FROM tva, tvb, mva, mvb, weight"""


@query(_HARTLEY)
def hartley(spark, sf):
    return estimate.dual_frame_estimator(*_dual(spark, sf), "v").select(r("total", 2).alias("total"), r("theta", 6).alias("theta"), r("se", 3).alias("se"))


@query(_HARTLEY.replace("greatest(0, least(1, (mvb.vt + mvb.c - mva.c) / (mva.vt + mvb.vt)))", "0.0::DOUBLE"))
def hartley_screening(spark, sf):
    return estimate.dual_frame_estimator(*_dual(spark, sf), "v", theta="screening").select(r("total", 2).alias("total"), r("theta", 6).alias("theta"), r("se", 3).alias("se"))


@query(f"""WITH {_DUAL} {_moments("va")}, {_moments("vb")},
s AS (SELECT mva.vt + mvb.vt AS s11, mva.vn + mvb.vn AS s22, mva.cn + mvb.cn AS s12, mva.c - (mvb.c + mvb.vt) AS r1, mva.co - (mvb.co + mvb.cn) AS r2, mva.vo + mvb.vo + mvb.vt + 2 * mvb.c AS base FROM mva, mvb),
b AS (SELECT *, -(s22 * r1 - s12 * r2) / (s11 * s22 - s12 * s12) AS b1, -(s11 * r2 - s12 * r1) / (s11 * s22 - s12 * s12) AS b2 FROM s)
SELECT round(tva.own + tvb.own + tvb.ab + b1 * (tva.ab - tvb.ab) + b2 * (tva.one - tvb.one), 2) AS total, round(b1, 5) AS beta_1, round(b2, 2) AS beta_2,
  round(sqrt(base + b1 * b1 * s11 + b2 * b2 * s22 + 2 * b1 * b2 * s12 + 2 * b1 * r1 + 2 * b2 * r2), 2) AS se FROM b, tva, tvb""")
def fuller_burmeister(spark, sf):
    out = estimate.dual_frame_estimator(*_dual(spark, sf), "v", estimator="fuller-burmeister")
    return out.select(r("total", 2).alias("total"), r("beta_1", 5).alias("beta_1"), r("beta_2", 2).alias("beta_2"), r("se", 2).alias("se"))


_BALANCE = f"""WITH {SRS}, near AS (SELECT f.stratum, f.pi, arg_min(s.unit, ((f.x - s.x) * (f.x - s.x) + (f.y - s.y) * (f.y - s.y), s.unit)) AS who
  FROM sample f JOIN sample s ON s.sampled AND s.stratum = f.stratum GROUP BY f.unit, f.stratum, f.pi),
mass AS (SELECT stratum, who, sum(pi) AS v FROM near GROUP BY ALL),
parts AS (SELECT s.stratum, count(*) AS n, avg((coalesce(m.v, 0) - 1) * (coalesce(m.v, 0) - 1)) AS balance FROM sample s LEFT JOIN mass m ON m.who = s.unit WHERE s.sampled GROUP BY s.stratum)"""


@query(f"{_BALANCE} SELECT round(sum(balance * n) / sum(n), 8) AS balance, sum(n)::BIGINT AS n FROM parts")
def spatial_balance(spark, sf):
    return rounded(estimate.spatial_balance(srs(spark, sf)), balance=8)


@query(f"{_BALANCE} SELECT stratum, n, round(balance, 8) AS balance FROM parts")
def spatial_balance_by_stratum(spark, sf):
    return rounded(estimate.spatial_balance(srs(spark, sf), by_stratum=True), balance=8)


# --- overlap, survey hand-off ---------------------------------------------------------------------
_OVERLAP = f"""WITH {CELLS}, {LISTED}, near AS (SELECT l.unit, arg_min(c.unit, (greatest(abs(l.x - c.x), abs(l.y - c.y)), c.unit)) AS cell FROM listed l JOIN cells c
  ON greatest(abs(l.x - c.x), abs(l.y - c.y)) <= 0.5 + 1e-9 GROUP BY l.unit),
placed AS (SELECT l.unit, cell, CASE WHEN cell IS NULL THEN 'b' ELSE 'ab' END AS domain FROM listed l LEFT JOIN near USING (unit))"""


@query(f"{_OVERLAP} SELECT * FROM placed")
def frame_overlap_list(spark, sf):
    return frame_overlap(listed(spark, sf), cells(spark, sf), 1.0, ["x", "y"]).list.select("unit", "cell", "domain")


@query(f"{_OVERLAP} SELECT c.unit, count(p.unit) AS n_listed, CASE WHEN count(p.unit) > 0 THEN 'ab' ELSE 'a' END AS domain, list(p.unit ORDER BY p.unit) FILTER (WHERE p.unit IS NOT NULL) AS listed_units FROM cells c LEFT JOIN placed p ON p.cell = c.unit GROUP BY c.unit")
def overlap_cells(spark, sf):
    return frame_overlap(listed(spark, sf), cells(spark, sf), 1.0, ["x", "y"]).cells.select("unit", "n_listed", "domain", "listed_units")


@query(f"WITH {SRS}, valued AS (SELECT *, v AS z FROM sample), {_STRATIFIED} SELECT round(total, 2) AS total, round(sqrt(v), 3) AS se FROM overall, variance")
def svytotal(spark, sf):
    return rounded(survey.svytotal(survey.as_svydesign(srs(spark, sf), "srs"), "v"), total=2, se=3)


@query(f"""WITH {SRS}, regions AS (SELECT DISTINCT nation % 5 AS domain FROM sample WHERE sampled),
valued AS (SELECT r.domain, s.stratum, s.n, s.big, CASE WHEN s.nation % 5 = r.domain THEN v ELSE 0 END AS z FROM sample s, regions r WHERE sampled)
SELECT domain, round(sum(t), 2) AS total, round(sqrt(sum(w)), 3) AS se FROM
 (SELECT domain, stratum, sum(z) * max(big) / max(n) AS t, max(big) * max(big) * (1 - max(n)::DOUBLE / max(big)) * var_samp(z) / max(n) AS w FROM valued GROUP BY ALL) GROUP BY domain""")
def svyby(spark, sf):
    d = survey.as_svydesign(srs(spark, sf), "srs").withColumn("domain", F.col("nation") % 5)
    return rounded(survey.svytotal(d, "v", ["domain"]), total=2, se=3)


@query(f"""WITH {systematic_sql(REPLICATES)}, each AS ({" UNION ALL ".join(f"SELECT sum(v / q) FILTER (WHERE in{k}) AS e FROM sample" for k in range(REPLICATES))})
SELECT round(avg(e), 2) AS total, round(sqrt(var_pop(e) / {REPLICATES - 1}), 3) AS se FROM each""")
def svy_replicates(spark, sf):
    return rounded(survey.svytotal(survey.as_svydesign(systematic(spark, sf, REPLICATES)), "v"), total=2, se=3)


# --- travel and cost --------------------------------------------------------------------------------
def _sampled_points(spark, sf) -> DataFrame:
    return srs(spark, sf).sampled().select("unit", (F.col("x") * 0.01 - 8).alias("lat"), (F.col("y") * 0.01 - 35).alias("lon"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


@query(f"""WITH {SRS}, p AS (SELECT unit, x * 0.01::DOUBLE - 8 AS lat, y * 0.01::DOUBLE - 35 AS lon FROM sample WHERE sampled)
SELECT a.unit AS "from", b.unit AS "to", round(1.3::DOUBLE * 2 * 6371 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 6) AS travel FROM p a, p b""")
def haversine_matrix(spark, sf):
    return rounded(travel.travel_matrix(_sampled_points(spark, sf), "haversine", detour=1.3, coords=["lat", "lon"]).df, travel=6)


@query(f"""WITH {SRS}, p AS (SELECT unit, x, y FROM sample WHERE sampled)
SELECT a.unit AS "from", b.unit AS "to", round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))::DOUBLE / 40 * 60, 6) AS travel FROM p a, p b""")
def euclid_matrix_speed(spark, sf):
    return rounded(travel.travel_matrix(_sampled_points(spark, sf), "euclidean", speed=40, coords=["x", "y"]).df, travel=6)


_DEPOT = -1  # no customer's key


def _given_routes(spark, sf) -> DataFrame:
    """Routes of up to six sampled units of a stratum in order of their number, from one depot unit. Beyond 600 sampled units
    in a stratum, routes of several strata share numbers; the stratum's number ``g`` then orders stops of one number."""
    from pyspark.sql import Window as W

    s = srs(spark, sf).sampled()
    place = F.row_number().over(W.partitionBy("stratum").orderBy("unit")) - 1
    rank = F.dense_rank().over(W.orderBy("stratum"))  # strata are few
    rows = s.withColumn("i", place).withColumn("g", rank)
    return rows.select((F.col("g") * 100 + F.floor(F.col("i") / 6)).cast("int").alias("route"), (F.col("i") % 6 + 1).cast("int").alias("stop"), "unit", F.lit(_DEPOT).cast("long").alias("depot"), "g")


def _depot_travel(spark, sf) -> travel.TravelMatrix:
    base = spark.createDataFrame([(_DEPOT, 20.0, 15.0)], "unit long, x double, y double")
    return travel.travel_matrix(_sampled_points(spark, sf), "euclidean", bases=base, coords=["x", "y"])


_ROUTES = f"""WITH {SRS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY unit) - 1 AS i, dense_rank() OVER (ORDER BY stratum) AS g FROM sample WHERE sampled),
stops AS (SELECT CAST(g * 100 + i // 6 AS INT) AS route, CAST(i % 6 + 1 AS INT) AS stop, unit, x, y FROM numbered),
legs AS (SELECT *, sqrt(pow(x - coalesce(lag(x) OVER w, 20), 2) + pow(y - coalesce(lag(y) OVER w, 15), 2)) AS leg, sqrt(pow(x - 20, 2) + pow(y - 15, 2)) AS home, lead(unit) OVER w IS NULL AS last
  FROM stops WINDOW w AS (PARTITION BY route ORDER BY stop))"""


@query(f"{_ROUTES} SELECT route, stop, unit, round(leg, 6) AS leg FROM legs")
def route_legs(spark, sf):
    return rounded(routing.legs(_given_routes(spark, sf), _depot_travel(spark, sf), ties=("g",)), leg=6)


@query(f"{_ROUTES} SELECT route, count(*) AS stops, round(sum(leg + CASE WHEN last THEN home ELSE 0 END), 6) AS length FROM legs GROUP BY route")
def route_summary(spark, sf):
    return rounded(routing.route_summary(_given_routes(spark, sf), _depot_travel(spark, sf), ties=("g",)), length=6).select("route", "stops", "length")


@query(f"""{_ROUTES} SELECT round(2 * t, 4) AS cost_travel, 50.0::DOUBLE * n_routes AS cost_routes, 30.0::DOUBLE * units AS cost_units, 40.0::DOUBLE * units AS cost_interviews, round(2 * t + 50 * n_routes + 70 * units, 4) AS cost_total
FROM (SELECT sum(leg + CASE WHEN last THEN home ELSE 0 END) AS t, count(*) AS units, count(DISTINCT route) AS n_routes FROM legs)""")
def cost_of(spark, sf):
    model = travel.CostModel(per_travel=2, per_unit=30, per_interview=10, interviews_per_unit=4, per_route=50)
    s = routing.route_summary(_given_routes(spark, sf), _depot_travel(spark, sf), ties=("g",))
    totals = s.agg(F.sum("length").alias("t"), F.sum("stops").alias("units"), F.count(F.lit(1)).alias("routes"))
    return rounded(totals.select(*model.columns(F.col("t"), F.col("units"), F.col("routes"))), cost_travel=4, cost_total=4)


@query(f"""{_ROUTES} SELECT route, stop, round(coalesce(lag(x) OVER w, 20), 4)::DOUBLE AS x, round(coalesce(lag(y) OVER w, 15), 4)::DOUBLE AS y, x::DOUBLE AS xend, y::DOUBLE AS yend FROM stops WINDOW w AS (PARTITION BY route ORDER BY stop)
UNION ALL SELECT route, (stop + 1)::INT, x, y, 20.0, 15.0 FROM legs WHERE last""")
def route_segments(spark, sf):
    base = spark.createDataFrame([(_DEPOT, 20.0, 15.0)], "unit long, x double, y double")
    units = _sampled_points(spark, sf).select("unit", "x", "y").unionByName(base)
    return routing.route_segments(_given_routes(spark, sf), units, ("x", "y"), ties=("g",))


def _field_sample(spark, sf) -> DataFrame:
    """All units of a design of 60, what the teams of the plan below can visit."""
    s = select_units(cells(spark, sf), LEAST_SRS, strata="stratum", method="srs", seed=SEED)
    return s.sampled().select(F.col("unit").cast("string").alias("unit"), F.col("x").cast("double"), F.col("y").cast("double"))


def _plan(spark, sf) -> schedule.Schedule:
    p = _field_sample(spark, sf)
    bases = spark.createDataFrame([("north", 10.0, 5.0), ("south", 30.0, 25.0)], "unit string, x double, y double")
    names = [x["unit"] for x in p.orderBy("unit").collect()]
    m = travel.travel_matrix(p, "euclidean", bases=bases, coords=["x", "y"])
    days = -(-len(names) // 15)  # two bases of two teams with four stops a day
    return schedule.schedule_fieldwork(m, names, {"north": 2, "south": 2}, days, max_stops=4, service_time=1.0, iterations=20, seed=1)


_UNITS = f"WITH {SRS.replace(N_SRS, str(LEAST_SRS))}, units AS (SELECT unit::VARCHAR AS unit FROM sample WHERE sampled), days AS (SELECT (count(*) + 14) // 15 AS days FROM units)"


@query(f"{_UNITS} SELECT unit, 1::BIGINT AS visits, true AS within FROM units")
def schedule_tidy(spark, sf):
    """Every sampled unit is visited once, on one of the days and as one of four stops at most."""
    plan = _plan(spark, sf)
    within = F.col("day").between(1, plan.days) & F.col("stop").between(1, 4)
    return plan.tidy(spark).groupBy("unit").agg(F.count(F.lit(1)).alias("visits"), F.bool_and(within).alias("within"))


@query(f"{_UNITS} SELECT base, 2::INT AS teams, days::INT AS days_available, true AS fits, true AS counted FROM days, (VALUES ('north'), ('south')) b(base)")
def schedule_summary(spark, sf):
    """The summary by base, counted again from the visits."""
    plan = _plan(spark, sf)
    again = plan.tidy(spark).groupBy("base").agg(F.count(F.lit(1)).alias("visits"), F.countDistinct("route").alias("trips"), F.max("day").alias("last"))
    rows = spark.createDataFrame(plan.summary, schedule.SUMMARY).join(again, "base")
    counted = (F.col("visits") == F.col("units")) & (F.col("trips") == F.col("routes")) & (F.col("last") == F.col("days_needed"))
    return rows.select("base", "teams", "days_available", "fits", counted.alias("counted"))


@query(f"{_UNITS} SELECT count(*) AS units, 0::BIGINT AS clashes, true AS earliest, true AS least_sum FROM units")
def calendar(spark, sf):
    """No team has two routes a day, the last day is as early as teams allow, and so is the sum of days."""
    plan = schedule.schedule_calendar(_plan(spark, sf), time_limit=5)
    c = plan.calendar_df(spark)
    clashes = c.groupBy("team", "day").count().where("count > 1").agg(F.count(F.lit(1)).alias("clashes"))
    by = c.groupBy("base").agg(F.count(F.lit(1)).alias("k"), F.max("day").alias("last"), F.sum("day").alias("days"), F.sum("stops").alias("units"))
    full = F.floor(F.col("k") / 2)  # days on which both teams of a base are out
    by = by.agg(F.sum("units").alias("units"), F.bool_and(F.col("last") == F.ceil(F.col("k") / 2)).alias("earliest"), F.bool_and(F.col("days") == full * (full + 1) + (F.col("k") % 2) * (full + 1)).alias("least_sum"))
    return by.crossJoin(clashes).select("units", "clashes", "earliest", "least_sum")


@query(f"{_UNITS} SELECT unit, 1::BIGINT AS visits, true AS within, true AS measured FROM units")
def routes(spark, sf):
    """Every sampled unit is on one route of six stops at most, and the routes are as long as their legs."""
    p = _field_sample(spark, sf)
    base = spark.createDataFrame([("depot", 20.0, 15.0)], "unit string, x double, y double")
    names = [x["unit"] for x in p.orderBy("unit").collect()]
    matrix = travel.travel_matrix(p, "euclidean", bases=base, coords=["x", "y"])
    plan = routing.route_fieldwork(matrix, names, "depot", max_stops=6, iterations=30)
    length = routing.route_summary(plan.stops_df(spark), matrix.df).agg(F.sum("length").alias("length"))
    rows = plan.stops_df(spark).groupBy("unit").agg(F.count(F.lit(1)).alias("visits"), F.bool_and(F.col("stop") <= 6).alias("within"))
    return rows.crossJoin(F.broadcast(length)).select("unit", "visits", "within", (F.abs(F.col("length") - plan.total) < 1e-6 * plan.total).alias("measured"))


# --- allocation and designs -------------------------------------------------------------------------
_PRICE = {"AUTOMOBILE": 40.0, "BUILDING": 60.0, "FURNITURE": 90.0, "HOUSEHOLD": 120.0, "MACHINERY": 180.0}
_PRICES = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in _PRICE.items())


@query(f"""WITH {CELLS}, strata AS (SELECT stratum, count(*) AS size, stddev_samp(v) AS sd, CASE stratum {_PRICES} END AS cost FROM cells GROUP BY stratum),
k AS (SELECT sum(size * sd * sqrt(cost)) / (pow(0.04::DOUBLE * (SELECT sum(v) FROM cells), 2) + sum(size * sd * sd)) AS k FROM strata)
SELECT stratum, CAST(greatest(2, least(size, ceil(k * size * sd / sqrt(cost) - 1e-9))) AS BIGINT) AS n FROM strata, k""")
def neyman_variance(spark, sf):
    c = cells(spark, sf)
    total = c.agg(F.sum("v")).first()[0]
    return allocation.frame_allocation(allocation.strata_table(c, "stratum", "v", _PRICE), target_variance=(0.04 * total) ** 2).tidy(spark).select("stratum", "n")


@query(f"""WITH RECURSIVE {CELLS}, strata AS (SELECT stratum, count(*) AS size, stddev_samp(v) AS sd, CASE stratum {_PRICES} END AS cost FROM cells GROUP BY stratum),
start AS (SELECT *, CAST(greatest(2, least(size, floor({{budget}} * size * sd / sqrt(cost) / (SELECT sum(size * sd * sqrt(cost)) FROM strata) + 1e-9))) AS BIGINT) AS n FROM strata),
steps AS (SELECT 0 AS step, stratum, size, sd, cost, n FROM start UNION ALL
  SELECT step + 1, stratum, size, sd, cost, n + CAST(stratum = pick AS INT)
  FROM (SELECT *, arg_max(stratum, CASE WHEN can THEN size * size * sd * sd * (1.0::DOUBLE / n - 1.0::DOUBLE / (n + 1)) / cost ELSE -1 END) OVER (PARTITION BY step) AS pick, bool_or(can) OVER (PARTITION BY step) AS more
        FROM (SELECT *, n + 1 <= size AND sum(n * cost) OVER (PARTITION BY step) + cost <= {{budget}} + 1e-9 AS can FROM steps)) WHERE more)
SELECT stratum, n, n * cost AS cost_total FROM steps WHERE step = (SELECT max(step) FROM steps)""".replace("{budget}", "(60.0::DOUBLE * (SELECT count(*) FROM cells))"))
def neyman_budget(spark, sf):
    c = cells(spark, sf)
    a = allocation.frame_allocation(allocation.strata_table(c, "stratum", "v", _PRICE), budget=60.0 * c.count())
    return a.tidy(spark).select("stratum", "n", "cost_total")


@query("""WITH g AS (SELECT m::DOUBLE AS m, least(floor(100000 / (300 + 20 * m)), 5000)::DOUBLE AS n FROM range(1, 21) t(m)),
c AS (SELECT n, m, n * (300 + 20 * m) AS cost, ((1 - n / 5000) * 4 / n + greatest(0, 1 - m / 20) * 25 / (n * m)) * pow(100000, 2) AS variance FROM g WHERE n >= 2)
SELECT n, m, cost, round(variance, 2) AS variance FROM c ORDER BY c.variance LIMIT 1""")
def two_stage_grid(spark, sf):
    return rounded(analytics.best_of(analytics.two_stage_grid(spark, 5000, 20, 4, 25, 300, 20, 100000), "variance"), variance=2)


@query("""WITH g AS (SELECT n, m, n * (300 + 20 * m) AS cost FROM range(2, 313) x(n), range(1, 21) y(m)),
c AS (SELECT n, m, cost, ((1 - n / 5000) * 4 / n + greatest(0, 1 - m / 20) * 25 / (n * m)) AS variance FROM g WHERE cost <= 100000)
SELECT n, m, cost::DOUBLE AS cost FROM c ORDER BY variance, cost LIMIT 1""")
def two_stage_allocation(spark, sf):
    a = allocation.two_stage_allocation(5000, 20, 4, 25, 300, 20, budget=100000)
    return spark.createDataFrame([(a.n, a.m, float(a.cost))], "n long, m long, cost double")


@query("""WITH t AS (SELECT t / 1000.0::DOUBLE AS theta FROM range(0, 1001) x(t)),
m AS (SELECT *, (5000 * 12 + 800 * theta * 90) / 5800 AS ma, (150 * 110 + 800 * (1 - theta) * 90) / 950 AS mb FROM t),
s AS (SELECT theta, 1.6 * (4999 * 100 + 799 * theta * theta * 3600 + 5000 * (12 - ma) * (12 - ma) + 800 * (theta * 90 - ma) * (theta * 90 - ma)) / 5799 AS sa,
  (149 * 4900 + 799 * (1 - theta) * (1 - theta) * 3600 + 150 * (110 - mb) * (110 - mb) + 800 * ((1 - theta) * 90 - mb) * ((1 - theta) * 90 - mb)) / 949 AS sb FROM m),
w AS (SELECT *, 5800 * sqrt(sa / 220) AS wa, 950 * sqrt(sb / 35) AS wb FROM s),
ideal AS (SELECT *, 150000 * wa / (220 * wa + 35 * wb) AS a, 150000 * wb / (220 * wa + 35 * wb) AS b FROM w),
first_a AS (SELECT *, greatest(2, least(o, 5800, floor((150000 - 70) / 220))) AS n_a FROM (SELECT *, floor(a) AS o FROM ideal UNION ALL SELECT *, ceil(a) FROM ideal)),
first_b AS (SELECT *, least(950, greatest(2, floor(b))) AS n_b FROM ideal),
options AS (SELECT theta, sa, sb, n_a, least(950, greatest(2, floor((150000 - 220 * n_a) / 35))) AS n_b FROM first_a
  UNION ALL SELECT theta, sa, sb, least(5800, greatest(2, floor((150000 - 35 * n_b) / 220))), n_b FROM first_b),
v AS (SELECT n_a::BIGINT AS n_a, n_b::BIGINT AS n_b, theta, 220.0::DOUBLE * n_a + 35 * n_b AS cost, 5800 * 5800 * sa / n_a * (1 - n_a / 5800) + 950 * 950 * sb / n_b * (1 - n_b / 950) AS variance FROM options)
SELECT n_a, n_b, theta, cost, round(variance, 0) AS variance FROM v WHERE cost <= 150000 ORDER BY v.variance, cost LIMIT 1""")
def dual_frame_allocation(spark, sf):
    domains = [{"domain": "a", "size": 5000, "mean": 12, "sd": 10}, {"domain": "ab", "size": 800, "mean": 90, "sd": 60}, {"domain": "b", "size": 150, "mean": 110, "sd": 70}]
    a = allocation.dual_frame_allocation(domains, 220, 35, deff_a=1.6, budget=150000)
    return spark.createDataFrame([(a.n_a, a.n_b, a.theta, float(a.cost), float(round(a.variance)))], "n_a long, n_b long, theta double, cost double, variance double")


@query(f"""WITH {CELLS}, strata AS (SELECT stratum, count(*) AS size, var_samp(size) AS a, var_samp(nation) AS b FROM cells GROUP BY stratum),
targets AS (SELECT pow(0.05 * sum(size), 2) AS a, pow(0.05 * sum(nation), 2) AS b FROM cells)
SELECT count(*) AS strata, true AS a_met, true AS b_met, true AS tight FROM strata, targets GROUP BY ALL""")
def multivariate_allocation(spark, sf):
    """Both variables meet their targets, and with one unit less in each stratum one of them would not."""
    c = cells(spark, sf)
    by = c.groupBy("stratum").agg(F.count(F.lit(1)).alias("size"), F.stddev_samp("size").alias("a"), F.stddev_samp("nation").alias("b")).orderBy("stratum").collect()
    totals = c.agg(F.sum("size"), F.sum("nation")).first()
    rows = [{"stratum": x["stratum"], "size": x["size"], "cost": 1.0, "a": x["a"], "b": x["b"]} for x in by]
    found = allocation.multivariate_allocation(rows, ["a", "b"], target_cv=[0.05, 0.05], totals=list(totals))

    def missed(n: list[int]) -> list[bool]:
        v = [sum(x["size"] ** 2 * x[k] ** 2 / m * (1 - m / x["size"]) for x, m in zip(rows, n, strict=True)) for k in "ab"]
        return [a > (0.05 * t) ** 2 * (1 + 1e-9) for a, t in zip(v, totals, strict=True)]

    a, b = missed(found.n)
    return spark.createDataFrame([(len(rows), not a, not b, any(missed([max(1, m - 1) for m in found.n])))], "strata long, a_met boolean, b_met boolean, tight boolean")


_CURVE = CostCurve(500.0, 30.0, 200.0, 1.0, [])


@query("SELECT p_size::DOUBLE AS n, round(500 + 30 * p_size + 200 * sqrt(p_size), 6) AS fitted, round((500 + 30 * p_size + 200 * sqrt(p_size)) / p_size, 6) AS average, round(30 + 100 / sqrt(p_size), 6) AS marginal FROM (SELECT DISTINCT p_size FROM part)")
def cost_curve_predict(spark, sf):
    n = read(spark, sf, "part").select(F.col("p_size").cast("double").alias("n")).distinct()
    return rounded(n.select("n", *_CURVE.columns(F.col("n"))), fitted=6, average=6, marginal=6)


def _field_frame(spark, sf) -> DataFrame:
    c = cells(spark, sf).select(F.col("unit").cast("string").alias("unit"), F.col("x").cast("double"), F.col("y").cast("double"), "v", "size")
    return c.unionByName(spark.createDataFrame([("depot", 20.0, 2.0, 0.0, 0.0)], "unit string, x double, y double, v double, size double"))


_FIELD = travel.CostModel(per_travel=2, per_unit=30, per_interview=10, interviews_per_unit=4, per_route=20)


def _frontier(spark, sf) -> DataFrame:
    return cost_variance_frontier(_field_frame(spark, sf), "depot", _FIELD, [8, 12, 16], y="v", max_stops=6, iterations=5, coords=["x", "y"])


@query("SELECT n::INT AS n, 20::BIGINT AS n_rep, true AS priced, true AS routed FROM (VALUES (8), (12), (16)) t(n)")
def frontier(spark, sf):
    """Costs are those of the travel, routes and units, and six stops at most make a route."""
    f = _frontier(spark, sf)
    priced = F.abs(F.col("cost_mean") - (2 * F.col("travel_mean") + 20 * F.col("routes_mean") + 70 * F.col("n"))) < 1e-6
    return f.select("n", "n_rep", priced.alias("priced"), (F.col("routes_mean") >= F.ceil(F.col("n") / 6)).alias("routed"))


@query("SELECT true AS fits, true AS centred, count(*) AS sizes FROM range(4)")
def cost_curve_fit(spark, sf):
    """The curve is near all measured costs, and what it misses them by sums to nothing."""
    c = routed_cost_curve(_field_frame(spark, sf), "depot", _FIELD, [6, 10, 14, 18], iterations=5, coords=["x", "y"]).tidy(spark)
    off = F.col("cost_mean") - F.col("fitted")
    return c.agg(F.bool_and(F.abs(off) < 0.1 * F.col("cost_mean")).alias("fits"), (F.abs(F.sum(off)) < 1e-6 * F.sum("cost_mean")).alias("centred"), F.count(F.lit(1)).alias("sizes"))


def _design_facts(spark, d, cost: float, budget: float) -> DataFrame:
    n = d.allocation.n if hasattr(d.allocation, "n") else d.allocation.n_a
    facts = (d.converged, d.cost <= budget * (1 + 1e-9), abs(d.cost - cost) < 1e-6 * cost, abs(d.unit_cost - d.curve.marginal(n)) < 1e-9)
    return spark.createDataFrame([facts], "converged boolean, affordable boolean, priced boolean, marginal boolean")


@query("SELECT true AS converged, true AS affordable, true AS priced, true AS marginal")
def two_stage_routed(spark, sf):
    d = two_stage_design(_field_frame(spark, sf), "depot", _FIELD, 20, 4.0, 25.0, budget=3000.0, iterations=3, coords=["x", "y"])
    return _design_facts(spark, d, d.curve.total(d.allocation.n) + 10 * d.allocation.n * d.allocation.m, 3000.0)


@query("SELECT true AS converged, true AS affordable, true AS priced, true AS marginal")
def dual_frame_routed(spark, sf):
    frame = _field_frame(spark, sf)
    n = frame.count() - 1
    both = n // 6  # the cells that the list covers too; the list has five units to two cells beyond them
    domains = [{"domain": "a", "size": n - both, "mean": 5, "sd": 6}, {"domain": "ab", "size": both, "mean": 60, "sd": 50}, {"domain": "b", "size": 5 * n // 2, "mean": 40, "sd": 30}]
    d = dual_frame_design(frame, "depot", _FIELD, domains, 12.0, budget=4000.0, iterations=3, coords=["x", "y"])
    return _design_facts(spark, d, d.curve.total(d.allocation.n_a) + 12 * d.allocation.n_b, 4000.0)


@query(f"""WITH {AREAS} SELECT 200::BIGINT AS n_sim, round(sum(s_acctbal), 2) AS total, true AS unbiased, true AS compared FROM supplier WHERE s_suppkey IN (SELECT establishment FROM areas)""")
def point_deff(spark, sf):
    """The mean of the simulations is within four standard errors of the total, and their variance is compared with that of SRS."""
    whole = _field_frame(spark, sf).where("unit <> 'depot'")
    land = areas(spark, sf).join(read(spark, sf, "supplier").select(F.col("s_suppkey").alias("establishment"), F.col("s_acctbal").alias("y")), "establishment")
    land = land.select(F.col("establishment").cast("string").alias("establishment"), F.col("unit").cast("string").alias("unit"), "area", "y")
    d = point_design_effect(whole, land, 20, 6, 1.0, method="srs", coords=["x", "y"])[0]
    unbiased, compared = F.abs("bias") <= 4 * F.sqrt(F.col("variance") / F.col("n_sim")), F.abs(F.col("deff") - F.col("variance") / F.col("variance_srs")) < 1e-9
    return d.select("n_sim", r("total", 2).alias("total"), unbiased.alias("unbiased"), compared.alias("compared"))


# --- analytics --------------------------------------------------------------------------------------
@query(f"""WITH {CELLS}, m AS (SELECT avg(v) AS m FROM cells),
pairs AS (SELECT a.unit, a.v - m.m AS e, b.v - m.m AS e2, row_number() OVER (PARTITION BY a.unit ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.unit) AS place
  FROM cells a JOIN cells b ON a.unit <> b.unit, m),
lag AS (SELECT unit, avg(e2) AS l, any_value(e) AS e FROM pairs WHERE place <= 8 GROUP BY unit)
SELECT round(sum(e * l) / sum(e * e), 8) AS moran_i, count(*) AS n FROM lag""")
def moran_i(spark, sf):
    return rounded(analytics.moran_i(cells(spark, sf), "v"), moran_i=8)


def _runs(spark, sf) -> DataFrame:
    """Line items as simulated estimates: designs by return flag, scenarios by status."""
    line = read(spark, sf, "lineitem")
    return line.select(F.col("l_linestatus").alias("scenario"), F.col("l_returnflag").alias("design"), F.col("l_quantity").alias("estimate"))


@query("""WITH v AS (SELECT l_linestatus AS scenario, l_returnflag AS design, var_samp(l_quantity) AS variance, avg(l_quantity) AS mean, count(*) AS runs FROM lineitem GROUP BY ALL)
SELECT scenario, design, round(variance, 6) AS variance, round(mean, 6) AS mean, runs, round(variance / max(CASE WHEN design = 'N' THEN variance END) OVER (PARTITION BY scenario), 6) AS deff FROM v""")
def mc_design_variance(spark, sf):
    return rounded(analytics.mc_design_variance(_runs(spark, sf), ["scenario"], reference="N"), variance=6, mean=6, deff=6)


@query("""WITH runs AS (SELECT l_returnflag AS design, l_quantity AS total, 100 + l_quantity AS variance, sqrt(100 + l_quantity) AS se, 2 + l_linenumber AS df FROM lineitem),
t AS (SELECT * FROM (VALUES (3, 3.182446305284263), (4, 2.7764451051977987), (5, 2.570581835636314), (6, 2.4469118511449692), (7, 2.3646242515927844), (8, 2.306004135204166), (9, 2.2621571627409915)) x(df, t))
SELECT design, round(avg(variance) / var_samp(total) - 1, 6) AS relative_bias, round(avg(CASE WHEN abs(total - 25) <= t * se THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage, round(avg(total) / 25 - 1, 6) AS bias, count(*) AS runs FROM runs JOIN t USING (df) GROUP BY design""")
def coverage_table(spark, sf):
    line = read(spark, sf, "lineitem")
    q = F.col("l_quantity")
    runs = line.select(F.col("l_returnflag").alias("design"), q.alias("total"), (100 + q).alias("variance"), F.sqrt(100 + q).alias("se"), (2 + F.col("l_linenumber")).cast("long").alias("df"), F.lit(25.0).alias("truth"))
    return rounded(analytics.coverage_table(runs, ["design"]), relative_bias=6, coverage=6, bias=6)


@query("""WITH p AS (SELECT p_brand AS design, p_size::DOUBLE AS n, avg(p_retailprice) AS travel FROM part GROUP BY ALL),
base AS (SELECT n AS x0, travel AS y0, lead(n) OVER (ORDER BY n) AS x1, lead(travel) OVER (ORDER BY n) AS y1, lag(n) OVER (ORDER BY n) IS NULL AS f FROM p WHERE design = (SELECT min(p_brand) FROM part)),
j AS (SELECT p.*, y0 + (n - x0) / (x1 - x0) * (y1 - y0) AS reference FROM p LEFT JOIN base ON x1 IS NOT NULL AND n <= x1 AND (n > x0 OR (f AND n = x0)) WHERE design <> (SELECT min(p_brand) FROM part))
SELECT design, n, round(travel / reference, 8) AS ratio FROM j""")
def travel_ratio(spark, sf):
    p = read(spark, sf, "part").groupBy(F.col("p_brand").alias("design"), F.col("p_size").cast("double").alias("n")).agg(F.avg("p_retailprice").alias("travel")).withColumn("frame", F.lit("all"))
    first = p.agg(F.min("design")).first()[0]
    return analytics.travel_ratio(p, ["frame"], reference=first).select("design", "n", r("ratio", 8).alias("ratio"))


@query("SELECT p_brand AS design, round(regr_slope(ln(p_retailprice), ln(p_size)), 8) AS exponent, round(sum(p_retailprice * sqrt(p_size)) / sum(p_size), 6) AS beta FROM part GROUP BY p_brand")
def travel_law(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_brand").alias("design"), F.col("p_size").cast("double").alias("n"), F.col("p_retailprice").alias("travel"))
    return rounded(analytics.travel_law(p, ["design"]), exponent=8, beta=6)


@query(f"WITH {CELLS} SELECT stratum, round(avg(CASE WHEN nation IN (1, 2, 3) THEN 1.0::DOUBLE ELSE 0 END), 8) AS low, round(avg(CASE WHEN nation IN (20, 21) THEN 1.0::DOUBLE ELSE 0 END), 8) AS high FROM cells GROUP BY stratum")
def zonal_shares(spark, sf):
    return rounded(areaframe.zonal_shares(cells(spark, sf), "stratum", "nation", {"low": [1, 2, 3], "high": [20, 21]}), low=8, high=8)


@query(f"""WITH {CELLS} SELECT CASE WHEN v <= 0 THEN 's1' WHEN v <= 5000 THEN 's2' ELSE 's3' END AS band, count(*) AS units,
  round((avg(v * v * v) - 3 * avg(v) * avg(v * v) + 2 * pow(avg(v), 3)) / pow(stddev_samp(v), 3), 5) AS skewness FROM cells GROUP BY 1""")
def stratify_skewness(spark, sf):
    c = analytics.stratify(cells(spark, sf), "v", [0, 5000], "band")
    return c.groupBy("band").agg(F.count(F.lit(1)).alias("units"), r(analytics.skewness("v"), 5).alias("skewness"))


_FLAGS = ["A", "N", "R"]


@query("""SELECT l_linestatus AS scenario, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'A'), 6) AS "A", round(avg(l_quantity) FILTER (WHERE l_returnflag = 'N'), 6) AS "N",
  round(avg(l_quantity) FILTER (WHERE l_returnflag = 'R'), 6) AS "R" FROM lineitem GROUP BY l_linestatus""")
def design_means_wide(spark, sf):
    means = _runs(spark, sf).groupBy("scenario", "design").agg(F.avg("estimate").alias("mean"))
    return rounded(analytics.wide(means, ["scenario"], "design", "mean", _FLAGS), **dict.fromkeys(_FLAGS, 6))


@query("""WITH v AS (SELECT l_linestatus AS scenario, l_returnflag AS design, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS variance FROM lineitem GROUP BY ALL)
SELECT scenario, design, 'mean' AS name, mean AS value FROM v UNION ALL SELECT scenario, design, 'variance', variance FROM v""")
def design_measures_long(spark, sf):
    by = _runs(spark, sf).groupBy("scenario", "design").agg(r(F.avg("estimate"), 6).alias("mean"), r(F.var_samp("estimate"), 6).alias("variance"))
    return analytics.long(by, ["scenario", "design"], ["mean", "variance"])


@query("""WITH v AS (SELECT p_brand AS design, p_size::DOUBLE AS n, avg(p_retailprice / p_size) AS variance FROM part GROUP BY ALL),
picked AS (SELECT design, (min(n) + max(n)) / 2 + 0.25 AS n FROM v GROUP BY design),
seg AS (SELECT design, n AS x0, variance AS y0, lead(n) OVER w AS x1, lead(variance) OVER w AS y1, lag(n) OVER w IS NULL AS f FROM v WINDOW w AS (PARTITION BY design ORDER BY n)),
j AS (SELECT p.design, p.n, exp(ln(y0) + (ln(p.n) - ln(x0)) / (ln(x1) - ln(x0)) * (ln(y1) - ln(y0))) AS affordable
  FROM picked p LEFT JOIN seg ON p.design = seg.design AND x1 IS NOT NULL AND p.n <= x1 AND (p.n > x0 OR (f AND p.n = x0))),
e AS (SELECT *, affordable / max(CASE WHEN design = (SELECT min(p_brand) FROM part) THEN affordable END) OVER () AS efficiency FROM j),
b AS (SELECT *, CASE WHEN n <= 40 THEN 'n <= 40' WHEN n <= 80 THEN '40 < n <= 80' ELSE 'n > 80' END AS band FROM e)
SELECT band, round(min(efficiency), 8) AS best, round(avg(efficiency), 8) AS mean, round(max(efficiency), 8) AS worst, round(avg(CASE WHEN efficiency < 1 THEN 1.0::DOUBLE ELSE 0 END), 8) AS wins, count(*) AS scenarios FROM b GROUP BY band""")
def efficiency_summary(spark, sf):
    """Brands as designs: variance falls with size; each affords the size in the middle of its own."""
    line = read(spark, sf, "part").groupBy(F.col("p_brand").alias("design"), F.col("p_size").cast("double").alias("n")).agg(F.avg(F.col("p_retailprice") / F.col("p_size")).alias("variance")).withColumn("frame", F.lit("all"))
    sizes = line.groupBy("frame", "design").agg(((F.min("n") + F.max("n")) / 2 + 0.25).alias("n"))
    first = line.agg(F.min("design")).first()[0]
    e = analytics.equal_budget_efficiency(line, sizes, ["frame"], reference=first).withColumn("band", analytics.size_band(F.col("n")))
    return rounded(analytics.efficiency_summary(e, ["band"]), best=8, mean=8, worst=8, wins=8)


_D3 = {"a": {"size": 5000, "mean": 12, "sd": 10}, "ab": {"size": 800, "mean": 90, "sd": 60}, "b": {"size": 150, "mean": 110, "sd": 70}}


@query("""WITH g AS (SELECT a::DOUBLE AS n_a, t / 100.0::DOUBLE AS theta, least(floor((150000 - 220.0::DOUBLE * a) / 35), 950)::DOUBLE AS n_b FROM range(2, 601) x(a), range(0, 101) y(t)),
m AS (SELECT *, (5000 * 12 + 800 * theta * 90) / 5800 AS ma, (150 * 110 + 800 * (1 - theta) * 90) / 950 AS mb FROM g WHERE n_b >= 2),
s AS (SELECT *, (4999 * 100 + 799 * theta * theta * 3600 + 5000 * (12 - ma) * (12 - ma) + 800 * (theta * 90 - ma) * (theta * 90 - ma)) / 5799 AS sa,
  (149 * 4900 + 799 * (1 - theta) * (1 - theta) * 3600 + 150 * (110 - mb) * (110 - mb) + 800 * ((1 - theta) * 90 - mb) * ((1 - theta) * 90 - mb)) / 949 AS sb FROM m),
v AS (SELECT n_a, n_b, theta, 220 * n_a + 35 * n_b AS cost, 1.6 * 5800 * 5800 * sa / n_a * (1 - n_a / 5800) + 950 * 950 * sb / n_b * (1 - n_b / 950) AS variance FROM s)
SELECT n_a, n_b, theta, cost, round(variance, 0) AS variance FROM v ORDER BY v.variance LIMIT 1""")
def dual_frame_grid(spark, sf):
    grid = analytics.dual_frame_grid(spark, _D3, 220.0, 35.0, 150000, 600, deff_a=1.6)
    return rounded(analytics.best_of(grid, "variance"), variance=0)


@query(f"""WITH {SRS} SELECT unit, x::DOUBLE AS x, y::DOUBLE AS y, stratum, sampled, round(pi, 9) AS pi FROM sample""")
def sample_points(spark, sf):
    from terrasample.operators.plotdata import sample_points as points_of

    return points_of(srs(spark, sf)).select("unit", F.col("x").cast("double"), F.col("y").cast("double"), "stratum", "sampled", r("pi", 9).alias("pi"))


@query("""SELECT s_suppkey AS unit, CASE WHEN x >= 10 AND x < 30 AND y >= 5 AND y < 20 AND NOT (x >= 15 AND x < 18 AND y >= 8 AND y < 12) THEN 'square' END AS cell
FROM (SELECT s_suppkey, (s_suppkey * 7) % 44 + 0.25::DOUBLE AS x, (s_suppkey * 3) % 38 + 0.25::DOUBLE AS y FROM supplier)""")
def points_in_polygons(spark, sf):
    import struct

    from terrasample.operators.polygons import points_in_polygons as join

    rings = [[(10, 5), (30, 5), (30, 20), (10, 20), (10, 5)], [(15, 8), (18, 8), (18, 12), (15, 12), (15, 8)]]
    wkb = struct.pack("<BII", 1, 3, 2) + b"".join(struct.pack("<I", len(ring)) + b"".join(struct.pack("<dd", *p) for p in ring) for ring in rings)
    shapes = spark.createDataFrame([("square", wkb)], "unit string, geom_wkb binary")
    return join(listed(spark, sf), shapes, 8.0).select("unit", "cell")


@query(f"{_UNITS} SELECT count(*) AS units, max(days)::BIGINT AS days, true AS fits, true AS travelled FROM units, days")
def schedule_glance(spark, sf):
    """One row, with the travel of all visits in order counted again."""
    plan = _plan(spark, sf)
    g = plan.glance()
    return spark.createDataFrame([(int(g["units"]), plan.days, plan.fits, abs(g["travel"] - float(plan.calendar["travel"].sum())) < 1e-6)], "units long, days long, fits boolean, travelled boolean")


@query("SELECT 3::BIGINT AS sizes, 8::INT AS n_min, 16::INT AS n_max, 20::BIGINT AS n_rep, true AS rising, true AS falling")
def frontier_glance(spark, sf):
    from terrasample.operators.frontier import frontier_glance as glance

    g = glance(_frontier(spark, sf))
    return g.select("sizes", "n_min", "n_max", "n_rep", (F.col("cost_min") < F.col("cost_max")).alias("rising"), (F.col("variance_min") < F.col("variance_max")).alias("falling"))


@query("""WITH t AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, value FROM events)
SELECT start, start + INTERVAL 1 DAY AS "end", round(sum(value / 2), 4) AS total, count(*) AS n_hits FROM t GROUP BY start""")
def hits_by_day(spark, sf):
    from terrasample.streaming.hits import running_totals

    hits = read(spark, sf, "events").select("ts", F.col("value").alias("y"), F.lit(2.0).alias("expected_hits"))
    return rounded(running_totals(hits), total=4)
