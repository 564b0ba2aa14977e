"""Hand-off of a sample to survey estimation: weights, replicate weights, totals by domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasample.operators.select import Sample, by_stratum


def as_svydesign(sample: Sample, variance: str = "brewer") -> DataFrame:
    """Sampled rows with ``_stratum, _prob, _weight`` and, for replicated designs, ``_repw`` and ``_scale``, else ``_fpc``
    (the stratum's size for 'srs', the probability for 'brewer') and ``_fraction``, the sampling fraction it stands for."""
    if variance not in ("brewer", "srs"):
        raise ValueError("variance must be brewer or srs")
    d = sample.design
    rows = sample.sampled().withColumn("_stratum", sample.stratum())
    if d.replicates > 1:
        each = F.transform("in_replicate", lambda v: F.when(v, 1 / F.col("pi_replicate")).otherwise(0.0))
        weight = F.aggregate(each, F.lit(0.0), lambda a, v: a + v) / d.replicates
        return rows.withColumn("_prob", F.col("pi")).withColumn("_weight", weight).withColumn("_repw", each).withColumn("_scale", F.lit(1.0 / (d.replicates * (d.replicates - 1))))
    size = by_stratum(d.sizes, F.col("_stratum")).cast("double")
    fraction = F.col("pi") if variance == "brewer" else by_stratum(d.n, F.col("_stratum")) / size
    rows = rows.withColumn("_prob", F.col("pi")).withColumn("_weight", 1 / F.col("pi"))
    return rows.withColumn("_fpc", F.col("pi") if variance == "brewer" else size).withColumn("_fraction", fraction)


def svytotal(design: DataFrame, y: str, by: list[str] | None = None) -> DataFrame:
    """Weighted totals, by domain if asked, with replicate standard errors where there are replicate weights, else
    Brewer's (with equal probabilities: the stratified SRS ones)."""
    by = by or []
    if "_repw" in design.columns:
        each = design.select(*by, (F.col(y) * F.col("_weight")).alias("_t"), "_scale", F.posexplode("_repw").alias("_k", "_w"), F.col(y).alias("_y"))
        totals = each.groupBy(*by, "_k").agg(F.sum("_t").alias("total"), F.sum(F.col("_w") * F.col("_y")).alias("_theta"), F.first("_scale").alias("_scale"))
        spread = F.first("_scale") * (F.var_pop("_theta") * F.count(F.lit(1)))
        return totals.groupBy(*by).agg(F.first("total").alias("total"), F.sqrt(spread).alias("se"))
    # a domain's total has every sampled unit of a stratum, with 0 for those outside the domain
    rest = 1 - F.col("_fraction")
    strata = design.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_n"), F.sum(rest).alias("_r"))
    t = F.col(y) * F.col("_weight")
    sums = design.groupBy(*by, "_stratum").agg(F.sum(t).alias("_t"), F.sum(rest * t).alias("_rt"), F.sum(rest * t * t).alias("_rtt")).join(strata, "_stratum")
    mean = F.col("_t") / F.col("_n")
    v = F.col("_n") / (F.col("_n") - 1) * (F.col("_rtt") - 2 * mean * F.col("_rt") + mean * mean * F.col("_r"))
    return sums.groupBy(*by).agg(F.sum("_t").alias("total"), F.sqrt(F.sum(v)).alias("se"))
