"""Design-based estimators. Each returns one row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasample.functions.checks import all_true, no_rows, requires
from terrasample.operators.select import Sample
from terrasample.operators.spatial import nearest_sampled, neighbours

FIELDS = "total double, variance double, se double, cv double, variance_srs double, n long, n_frame long, variance_method string, df long"


def ht_total(df: DataFrame, y: Column, pi: str = "pi", sampled: str = "sampled") -> DataFrame:
    """Horvitz-Thompson total."""
    return df.agg(F.coalesce(F.sum(F.when(F.col(sampled), y / F.col(pi))), F.lit(0.0)).alias("total"))


def srs_variance(n: Column, big_n: Column, s2: Column) -> Column:
    """Variance of a total under simple random sampling."""
    return big_n * big_n * (1 - n / big_n) * s2 / n


def local_mean_variance(sample: Sample, z: Column, k: int = 3) -> DataFrame:
    """Local-mean variance by stratum: each sampled unit against the mean of itself and its k nearest, ties included.

    Only sampled rows, a field budget's worth, reach the tasks, one per stratum.
    """
    coords = list(sample.design.coords)
    rows = sample.df.where("sampled").select(sample.stratum().alias("_s"), *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(coords)], (z / F.col("pi")).cast("double").alias("_e"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, e = pdf[[f"_c{i}" for i in range(len(coords))]].to_numpy(float), pdf["_e"].to_numpy(float)
        total = 0.0
        for i, near in enumerate(neighbours(x, k)):
            group = np.append(near, i)
            m = len(group)
            total += m / (m - 1) * (e[i] - e[group].mean()) ** 2 if m > 1 else 0.0
        return pd.DataFrame({"_s": [key[0]], "variance": [total]})

    return rows.groupBy("_s").applyInPandas(run, "_s string, variance double")


def ht_variance(sample: Sample, z: Column, total: Column | None = None, neighbours: int = 3) -> DataFrame:
    """Total and variance of ``z`` matched to the design: replicates if there are any, else stratum by stratum the SRS
    formula for equal-probability SRS and the local mean otherwise. ``variance_srs`` is the SRS formula over the whole frame,
    for reference."""
    d = sample.design
    z = F.when(F.col("sampled"), z.cast("double")).otherwise(F.lit(0.0))
    rows = sample.df.withColumn("_z", z).withColumn("_s", sample.stratum())
    zs = F.when(F.col("sampled"), F.col("_z"))
    whole = rows.agg(
        F.coalesce(F.sum(zs / F.col("pi")), F.lit(0.0)).alias("ht"), F.count(F.when(F.col("sampled"), 1)).alias("n"), F.count(F.lit(1)).alias("n_frame"),
        F.var_samp(zs).alias("s2"), *([total.alias("given")] if total is not None else []),
    )
    whole = whole.withColumn("variance_srs", srs_variance(F.col("n"), F.col("n_frame"), F.col("s2")))
    if d.replicates > 1:
        each = rows.select("_z", "pi_replicate", F.posexplode("in_replicate").alias("k", "taken"))
        each = each.groupBy("k").agg(F.coalesce(F.sum(F.when(F.col("taken"), F.col("_z") / F.col("pi_replicate"))), F.lit(0.0)).alias("estimate"))
        parts = each.agg(F.avg("estimate").alias("own"), (F.var_samp("estimate") / d.replicates).alias("variance"), F.lit("replicates").alias("variance_method"))
        df = F.lit(d.replicates - 1)
    else:
        lone = [k for k, n in d.n.items() if n < 2]  # sizes are the design's: no pass over the frame
        if lone:
            raise ValueError(f"strata with fewer than two sampled units have no variance: {', '.join(lone[:5])}")
        if d.method == "srs":
            by = rows.groupBy("_s").agg(F.count(F.when(F.col("sampled"), 1)).alias("n"), F.count(F.lit(1)).alias("n_frame"), F.var_samp(zs).alias("s2"))
            parts = by.agg(F.sum(srs_variance(F.col("n"), F.col("n_frame"), F.col("s2"))).alias("variance"))
            label = "srs"
        else:
            parts = local_mean_variance(Sample(rows, d), F.col("_z"), neighbours).agg(F.sum("variance").alias("variance"))
            label = "local mean"
        parts = parts.withColumn("variance_method", F.lit(("stratified " if len(d.n) > 1 else "") + label)).withColumn("own", F.lit(None).cast("double"))
        df = F.col("n") - len(d.n)
    out = whole.crossJoin(parts)  # one row each
    chosen = F.col("given") if total is not None else F.coalesce("own", "ht")
    out = out.withColumn("total", chosen).withColumn("se", F.sqrt("variance")).withColumn("df", df.cast("long"))
    out = out.withColumn("cv", F.when(F.col("total") != 0, F.col("se") / F.abs("total")))
    return out.select("total", "variance", "se", "cv", "variance_srs", "n", "n_frame", "variance_method", "df")


def design_variance(sample: Sample, y: str, neighbours: int = 3) -> DataFrame:
    """Total of ``y`` with its variance."""
    requires(sample.df, [y], "the sample")
    all_true(sample.df.where("sampled"), y=(F.col(y).isNotNull(), f"{y} is missing for some sampled unit"))
    return ht_variance(sample, F.col(y), neighbours=neighbours)


def ratio_estimator(sample: Sample, y: str, x: str, x_total: float | None = None) -> DataFrame:
    """Total of ``y`` by its ratio to ``x``, of which the frame's total is known. All its variances are quadratic forms in
    one covariance matrix of the two totals."""
    requires(sample.df, [y, x], "the sample")
    own = {k: F.when(F.col("sampled"), F.col(k).cast("double")) for k in (x, y)}
    facts = sample.df.agg(
        F.sum(F.col(x)).cast("double").alias("all"), F.count(F.lit(1)).alias("n_frame"), F.count(F.when(F.col("sampled"), 1)).alias("n"), F.var_samp(own[y]).alias("yy"),
        F.covar_samp(own[y], own[x]).alias("xy"), F.var_samp(own[x]).alias("xx"),
    ).first()
    (total_y, total_x), v = ht_covariances(sample, [F.col(y), F.col(x)])
    if not total_x > 0:
        raise ValueError(f"the estimated total of {x} must be positive")
    known = float(x_total if x_total is not None else facts["all"])
    ratio, grow = total_y / total_x, (known / total_x) ** 2
    residual = lambda yy, xy, xx: max(0.0, yy - 2 * ratio * xy + ratio * ratio * xx)
    n, everyone = facts["n"], facts["n_frame"]
    srs = everyone**2 * (1 - n / everyone) * residual(facts["yy"] or 0.0, facts["xy"] or 0.0, facts["xx"] or 0.0) / n
    variance, total, d = residual(v[0, 0], v[0, 1], v[1, 1]) * grow, known * ratio, sample.design
    method = "replicates" if d.replicates > 1 else ("stratified " if len(d.n) > 1 else "") + ("srs" if d.method == "srs" else "local mean")
    row = [total, variance, variance**0.5, variance**0.5 / abs(total) if total else None, srs * grow, n, everyone, method, float(v[0, 0]), ratio, known]
    row = [float(z) if isinstance(z, np.floating) else z for z in row]
    fields = "total double, variance double, se double, cv double, variance_srs double, n long, n_frame long, variance_method string, variance_ht double, ratio double, x_total double"
    return sample.df.sparkSession.createDataFrame([row], fields)


def point_estimator(hits: DataFrame, sample: Sample, neighbours: int = 3) -> DataFrame:
    """Total over establishments found at points: each hit counts y over its establishment's expected hits."""
    requires(hits, ["unit", "establishment", "y", "expected_hits"], "hits")
    # one pass over the hits; all that follows reads a row per cell and establishment
    parts = hits.groupBy("unit", "establishment").agg(
        F.sum(F.col("y") / F.col("expected_hits")).alias("_u"), F.count(F.lit(1)).alias("_hits"),
        F.bool_and(F.coalesce(F.col("expected_hits") > 0, F.lit(False))).alias("_e"), F.bool_and(F.col("y").isNotNull()).alias("_y"),
    ).persist(StorageLevel.MEMORY_AND_DISK)
    all_true(parts, e=(F.col("_e"), "expected hits must be positive"), y=(F.col("_y"), "y is missing for some hit"))
    no_rows(parts.select("unit").distinct().join(sample.sampled().select("unit"), "unit", "left_anti"), "hits refer to cells that are not sampled")
    rows = sample.df.join(parts.groupBy("unit").agg(F.sum("_u").alias("_u")), "unit", "left").withColumn("_u", F.coalesce("_u", F.lit(0.0)))
    out = ht_variance(Sample(rows, sample.design), F.col("_u") * F.col("pi"), F.sum("_u"), neighbours)
    count = parts.agg(F.coalesce(F.sum("_hits"), F.lit(0)).alias("n_hits"), F.countDistinct("establishment").alias("n_establishments"))
    return out.crossJoin(count)


def segment_values(tracts: DataFrame, kind: str) -> Column:
    if kind == "closed":
        return F.col("y_tract")
    if kind == "open":
        return F.when(F.col("headquarters"), F.col("y_total")).otherwise(0.0)
    if kind == "weighted":
        return F.col("y_total") * F.col("share")
    raise ValueError("type must be closed, open or weighted")


def segment_estimator(tracts: DataFrame, sample: Sample, kind: str = "closed", neighbours: int = 3) -> DataFrame:
    """Closed, open or weighted segment total."""
    needs = {"closed": ["y_tract"], "open": ["y_total", "headquarters"], "weighted": ["y_total", "share"]}
    value = segment_values(tracts, kind)
    requires(tracts, ["unit", *needs[kind]], "tracts")
    valid = {"v": (value.isNotNull(), "a tract's value is missing")}
    if kind == "weighted":
        valid["share"] = (F.col("share").between(0, 1), "shares must lie between 0 and 1")
    # one pass over the tracts; all that follows reads a row per segment
    by_segment = tracts.groupBy("unit").agg(F.sum(value).alias("_v"), *[F.bool_and(F.coalesce(c, F.lit(False))).alias(f"_ok_{k}") for k, (c, _) in valid.items()])
    by_segment = by_segment.persist(StorageLevel.MEMORY_AND_DISK)
    no_rows(by_segment.join(sample.sampled().select("unit"), "unit", "left_anti"), "tracts refer to segments that are not sampled")
    all_true(by_segment, **{k: (F.col(f"_ok_{k}"), message) for k, (_, message) in valid.items()})
    rows = sample.df.join(by_segment.select("unit", "_v"), "unit", "left").withColumn("_v", F.coalesce("_v", F.lit(0.0)))
    return ht_variance(Sample(rows, sample.design), F.col("_v"), neighbours=neighbours).withColumn("type", F.lit(kind))


def ht_covariances(sample: Sample, zs: list[Column], neighbours: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Totals of several variables and their covariance matrix, matched to the design as in ``ht_variance``, in one job."""
    d, m = sample.design, len(zs)
    names = [f"_z{i}" for i in range(m)]
    rows = sample.df.withColumn("_s", sample.stratum()).withColumns({k: F.when(F.col("sampled"), z.cast("double")).otherwise(F.lit(0.0)) for k, z in zip(names, zs, strict=True)})
    if d.replicates > 1:
        each = rows.select(*names, "pi_replicate", F.posexplode("in_replicate").alias("k", "taken"))
        sums = each.groupBy("k").agg(*[F.sum(F.when(F.col("taken"), F.col(k) / F.col("pi_replicate")).otherwise(0.0)).alias(k) for k in names]).collect()
        e = np.array([[r[k] for k in names] for r in sums])
        return e.mean(0), np.atleast_2d(np.cov(e.T)) / d.replicates
    if d.method == "srs":
        own = {k: F.when(F.col("sampled"), F.col(k)) for k in names}
        pairs = [(i, j) for i in range(m) for j in range(i, m)]
        by = rows.groupBy("_s").agg(
            F.count(F.when(F.col("sampled"), 1)).alias("n"), F.count(F.lit(1)).alias("n_frame"), *[F.sum(own[k] / F.col("pi")).alias(k) for k in names],
            *[F.covar_samp(own[names[i]], own[names[j]]).alias(f"_c{i}_{j}") for i, j in pairs],
        ).collect()
        total, cov = np.zeros(m), np.zeros((m, m))
        for r in by:
            if r["n"] < 2:
                raise ValueError(f"strata with fewer than two sampled units have no variance: {r['_s']}")
            total += np.array([r[k] or 0.0 for k in names])
            for i, j in pairs:
                v = r["n_frame"] ** 2 * (1 - r["n"] / r["n_frame"]) / r["n"] * r[f"_c{i}_{j}"]
                cov[i, j] += v
                cov[j, i] += v * (i != j)
        return total, cov
    x = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(d.coords)]
    k = neighbours
    rows = rows.where("sampled").select("_s", *x, *[(F.col(c) / F.col("pi")).alias(c) for c in names])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        from terrasample.operators.spatial import neighbours as nearest

        e, cov = pdf[names].to_numpy(float), np.zeros((m, m))
        for i, near in enumerate(nearest(pdf[[c for c in pdf if c.startswith("_x")]].to_numpy(float), k)):
            group = np.append(near, i)
            off = e[i] - e[group].mean(0)
            cov += len(group) / max(1, len(group) - 1) * np.outer(off, off)
        return pd.DataFrame({"total": [e.sum(0).tolist()], "cov": [cov.ravel().tolist()]})

    parts = rows.groupBy("_s").applyInPandas(run, "total array<double>, cov array<double>").collect()
    return sum(np.array(r["total"]) for r in parts), sum(np.array(r["cov"]).reshape(m, m) for r in parts)


def cov_ht(sample: Sample, z1: Column, z2: Column) -> float:
    """Covariance of two totals."""
    return float(ht_covariances(sample, [z1, z2])[1][0, 1])


def dual_frame_estimator(sample_a: Sample, sample_b: Sample, y: str, domain: str = "domain", theta: float | str | None = None, estimator: str = "hartley") -> DataFrame:
    """Hartley or Fuller-Burmeister total over two frames that overlap in domain 'ab'."""
    for name, s, allowed in (("A", sample_a, ["a", "ab"]), ("B", sample_b, ["b", "ab"])):
        requires(s.df, [y, domain], f"sample {name}")
        no_rows(s.sampled().where(F.col(domain).isNull() | ~F.col(domain).isin(allowed)), f"sample {name} may only have the domains {' and '.join(allowed)}")
    if estimator not in ("hartley", "fuller-burmeister"):
        raise ValueError("estimator must be hartley or fuller-burmeister")

    def part(s: Sample, name: str, ones: bool = False) -> Column:
        return F.when(F.col(domain) == name, F.lit(1.0) if ones else F.col(y)).otherwise(0.0)

    def three(s: Sample, own: str) -> tuple[np.ndarray, np.ndarray]:
        return ht_covariances(s, [part(s, own), part(s, "ab"), part(s, "ab", True)])

    (y_a, y_ab_a, m_a), va = three(sample_a, "a")
    (y_b, y_ab_b, m_b), vb = three(sample_b, "b")
    v_a, v_ab_a, c_a = va[0, 0], va[1, 1], va[0, 1]
    v_b, v_ab_b, c_b = vb[0, 0], vb[1, 1], vb[0, 1]
    n_a, n_b = sample_a.design.total, sample_b.design.total
    spark = sample_a.df.sparkSession
    if estimator == "hartley":
        fixed = theta is not None
        if theta == "screening":
            t = 0.0
        elif fixed:
            t = float(theta)
            if not 0 <= t <= 1:
                raise ValueError("theta must lie between 0 and 1")
        else:
            both = v_ab_a + v_ab_b
            t = min(1.0, max(0.0, (v_ab_b + c_b - c_a) / both)) if both > 0 else 0.5
        total = y_a + t * y_ab_a + (1 - t) * y_ab_b + y_b
        variance = v_a + t * t * v_ab_a + 2 * t * c_a + v_b + (1 - t) ** 2 * v_ab_b + 2 * (1 - t) * c_b
        extra, fields = [t, fixed], "theta double, theta_fixed boolean"
    else:
        s11, s22, s12 = v_ab_a + v_ab_b, va[2, 2] + vb[2, 2], va[1, 2] + vb[1, 2]
        v_base_b = v_b + v_ab_b + 2 * c_b
        r1, r2 = c_a - (c_b + v_ab_b), va[0, 2] - (vb[0, 2] + vb[1, 2])
        det = s11 * s22 - s12 * s12
        if det > 1e-9 * max(s11 * s22, 1e-300):
            b1, b2 = -(s22 * r1 - s12 * r2) / det, -(s11 * r2 - s12 * r1) / det
        else:
            b1, b2 = -r1 / max(s11, 1e-12), 0.0
        d1, d2 = y_ab_a - y_ab_b, m_a - m_b
        total = y_a + y_b + y_ab_b + b1 * d1 + b2 * d2
        variance = v_a + v_base_b + b1 * b1 * s11 + b2 * b2 * s22 + 2 * b1 * b2 * s12 + 2 * b1 * r1 + 2 * b2 * r2
        extra, fields = [b1, b2], "beta_1 double, beta_2 double"
    variance = max(0.0, variance)
    se = variance**0.5
    row = [float(total), float(variance), float(se), float(se / abs(total)) if total else None, estimator, *[v if isinstance(v, bool) else float(v) for v in extra], *map(float, (y_a, y_ab_a, y_ab_b, y_b)), n_a, n_b]
    return spark.createDataFrame([row], f"total double, variance double, se double, cv double, estimator string, {fields}, y_a double, y_ab_a double, y_ab_b double, y_b double, n_a long, n_b long")


def spatial_balance(sample: Sample, by_stratum: bool = False) -> DataFrame:
    """Mean squared difference from 1 of the probability mass nearest to each sampled unit, within strata.

    Sampled units, a field budget's worth, are broadcast in blocks of at most ``BLOCK`` points; each block is one pass over
    the frame that keeps the nearest so far. Ties go to the sampled unit that is first by unit.
    """
    d = sample.design
    coords = list(d.coords)
    xs = [F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(coords)]
    rows = sample.df.select(sample.stratum().alias("_s"), "pi", *xs, F.lit(None).cast("double").alias("_d"), F.lit(-1).cast("long").alias("_at"))
    names = [f"_c{i}" for i in range(len(coords))]
    points = sample.sampled().select(sample.stratum().alias("_s"), F.col("unit"), *xs)
    blocks = max(1, -(-d.total // BLOCK))
    fields = "_s string, pi double, " + ", ".join(f"{c} double" for c in names) + ", _d double, _at long"
    start = 0
    for b in range(blocks):
        pdf = points.where(F.pmod(F.xxhash64("unit"), F.lit(blocks)) == b).toPandas().sort_values(["_s", "unit"]).reset_index(drop=True)
        shared = sample.df.sparkSession.sparkContext.broadcast({s: (g[names].to_numpy(float), g.index.to_numpy() + start) for s, g in pdf.groupby("_s")})
        start += len(pdf)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for part in batches:
                stratum, place = part["_s"].to_numpy(), part[names].to_numpy(float)
                best, at = part["_d"].to_numpy(float, copy=True), part["_at"].to_numpy(copy=True)
                for s, (x, index) in shared.value.items():
                    own = np.flatnonzero(stratum == s)
                    if len(own):
                        near, d = nearest_sampled(place[own], x)
                        closer = ~(d >= best[own])  # or none so far
                        best[own[closer]], at[own[closer]] = d[closer], index[near[closer]]
                yield part.assign(_d=best, _at=at)

        rows = rows.mapInPandas(run, fields)
    mass = rows.where("_at >= 0").groupBy("_s", "_at").agg(F.sum("pi").alias("v"))
    # a sampled unit that shares its place with an earlier one has no mass: 1 each
    by = mass.groupBy("_s").agg(F.sum((F.col("v") - 1) * (F.col("v") - 1)).alias("off"), F.count(F.lit(1)).alias("cells"))
    from terrasample.operators.select import by_stratum as per

    n = per(d.n, F.col("_s"))
    by = by.select(F.col("_s").alias("stratum"), n.cast("long").alias("n"), ((F.col("off") + n - F.col("cells")) / n).alias("balance"))
    if by_stratum:
        return by
    return by.agg((F.sum(F.col("balance") * F.col("n")) / F.sum("n")).alias("balance"), F.sum("n").alias("n"))


#: Sampled points broadcast at a time.
BLOCK = 1_000_000
