"""Probability samples of a frame."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasample.functions.checks import distinct, requires, whole
from terrasample.functions.columns import HILBERT_BITS, hilbert, uniform
from terrasample.functions.numeric import largest_remainder
from terrasample.operators.ordering import lowest, running_total, with_index
from terrasample.operators.spatial import cube, cube_flight, local_pivotal, pivotal_flight

METHODS = ("lpm", "systematic", "srs", "cube")
ONE = "all"


@dataclass(frozen=True)
class Design:
    """How a sample was drawn. ``n`` is by stratum in level order; without strata the one stratum is 'all'."""

    n: dict[str, int]
    sizes: dict[str, int]
    coords: tuple[str, ...]
    strata: str | None
    method: str
    seed: int
    size: str | None = None
    replicates: int = 1
    balance: tuple[str, ...] = ()

    @property
    def total(self) -> int:
        return sum(self.n.values())


@dataclass(frozen=True)
class Sample:
    """A frame with ``pi``, ``sampled`` and, with replicates, ``n_replicates``, ``in_replicate`` and ``pi_replicate``."""

    df: DataFrame
    design: Design

    def sampled(self) -> DataFrame:
        return self.df.where("sampled")

    def stratum(self) -> Column:
        return F.col(self.design.strata).cast("string") if self.design.strata else F.lit(ONE)

    def __repr__(self) -> str:
        d = self.design
        return f"<sample of {d.total} from {sum(d.sizes.values())} units, {d.method}, {len(d.n)} strata, {d.replicates} replicates>"


def infer_coords(df: DataFrame, coords: list[str] | None) -> list[str]:
    if coords:
        requires(df, coords, "the frame")
        return list(coords)
    for pair in (["lat", "lon"], ["x", "y"]):
        if all(c in df.columns for c in pair):
            return pair
    raise ValueError("the frame has neither lat and lon nor x and y; name its coordinates")


def task_seed(*parts) -> int:
    """A seed that depends on what is drawn, never on where a task runs."""
    return int.from_bytes(hashlib.md5(":".join(map(str, parts)).encode()).digest()[:8], "big")


def by_stratum(values: Mapping[str, float], stratum: Column) -> Column:
    """A number per stratum as an expression; strata are a design's own, so there are few."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[stratum]


def pps_thresholds(frame: DataFrame, stratum: Column, size: str, n: Mapping[str, int]) -> dict[str, float]:
    """Size from which a unit is certain, by stratum; smaller ones have probability size / threshold.

    Certain units are set aside and the rest shared out again until none is added. A pass counts, by stratum, the
    units at or above the threshold and sums the others.
    """
    total = {r["s"]: r["t"] for r in frame.groupBy(stratum.alias("s")).agg(F.sum(size).alias("t")).collect()}
    threshold = {k: total[k] / n[k] for k in n if n[k]}
    while True:
        at = by_stratum(threshold, stratum)
        big = F.col(size) >= at
        rows = frame.groupBy(stratum.alias("s")).agg(F.count(F.when(big, 1)).alias("k"), F.coalesce(F.sum(F.when(~big, F.col(size))), F.lit(0.0)).alias("rest")).collect()
        new = {r["s"]: r["rest"] / (n[r["s"]] - r["k"]) if n[r["s"]] > r["k"] and r["rest"] > 0 else threshold[r["s"]] for r in rows if r["s"] in threshold}
        if all(abs(new[k] - threshold[k]) <= 1e-15 * abs(threshold[k]) for k in new):
            return threshold
        threshold = new


def inclusion_probabilities(frame: DataFrame, n: Mapping[str, int] | int, size: str, strata: str | None = None) -> DataFrame:
    """``frame`` with ``pi`` proportional to size; units that would exceed 1 are certain."""
    stratum = F.col(strata).cast("string") if strata else F.lit(ONE)
    n = {ONE: n} if isinstance(n, int) else dict(n)
    threshold = by_stratum(pps_thresholds(frame, stratum, size, n), stratum)
    return frame.withColumn("pi", F.when(F.col(size) >= threshold, F.lit(1.0)).otherwise(F.col(size) / threshold))


def allocate_n(n, totals: dict[str, float], sizes: dict[str, int], levels: list[str]) -> dict[str, int]:
    """Sizes by stratum: given ones in level order, or a total shared in proportion to ``totals`` (rows if they are 0)."""
    if isinstance(n, Mapping):
        missing = [k for k in levels if k not in n]
        if missing:
            raise ValueError(f"n does not cover the strata {', '.join(missing)}")
        return {k: whole(n[k], "n", 1) for k in levels}
    n = whole(n, "n", 1)
    if n < len(levels):
        raise ValueError(f"n must be at least the number of strata, {len(levels)}")
    base = totals if sum(totals.values()) > 0 else sizes
    all_of = sum(base.values())
    return dict(zip(levels, largest_remainder([n * base[k] / all_of for k in levels], n), strict=True))


def prepared(frame: DataFrame, n, size: str | None, coords: list[str] | None, strata: str | None, method: str, replicates: int, seed: int, balance: list[str] | None = None, levels: list[str] | None = None) -> tuple[DataFrame, Column, Design]:
    """A checked frame with its strata ``_s`` and sizes ``_z``, the probability of its rows, and the design."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    seed, replicates = whole(seed, "seed"), whole(replicates, "replicates", 1)
    coords = infer_coords(frame, coords)
    if "unit" not in frame.columns:
        frame = with_index(frame, "unit").withColumn("unit", F.concat(F.lit("u"), F.col("unit").cast("string")))
    requires(frame, [c for c in (size, strata, *(balance or [])) if c], "the frame")
    if method == "srs" and size:
        raise ValueError("simple random sampling takes no size; use another method")
    if method == "systematic" and len(coords) != 2:
        raise ValueError("systematic sampling needs two coordinates")
    if replicates > 1 and method != "systematic":
        raise ValueError("replicates need method 'systematic'")
    if balance and method != "cube":
        raise ValueError("balance needs method 'cube'")

    stratum = F.col(strata).cast("string") if strata else F.lit(ONE)
    conditions = {"coords": (F.lit(True), "")}
    for i, c in enumerate(coords):
        conditions[f"c{i}"] = (F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), f"coordinate {c} is missing for some unit")
    if strata:
        conditions["s"] = (F.col(strata).isNotNull(), f"stratum {strata} is missing for some unit")
    if size:
        conditions["z"] = ((F.col(size) >= 0) & F.col(size).isNotNull(), f"size {size} must not be missing or negative")
    for i, c in enumerate(balance or []):
        conditions[f"b{i}"] = (F.col(c).isNotNull(), f"balancing variable {c} is missing for some unit")
    distinct(frame, "unit", "units that are not distinct")

    z = F.col(size).cast("double") if size else F.lit(1.0)
    checks = [F.bool_and(F.coalesce(c, F.lit(False))).alias(f"ok_{k}") for k, (c, _) in conditions.items()]
    rows = frame.groupBy(stratum.alias("s")).agg(F.count(F.lit(1)).alias("units"), F.sum(z).alias("t"), F.count(F.when(z > 0, 1)).alias("pos"), *checks).collect()
    for k, (_, message) in conditions.items():
        if not all(r[f"ok_{k}"] for r in rows):
            raise ValueError(message)
    found = {r["s"]: r for r in rows}
    levels = [str(k) for k in levels] if levels else sorted(found)
    levels = [k for k in levels if k in found]
    sizes = {k: found[k]["units"] for k in levels}
    n_h = allocate_n(n, {k: found[k]["t"] for k in levels}, sizes, levels)
    for k in levels:
        if n_h[k] > sizes[k]:
            raise ValueError(f"stratum {k} has {sizes[k]} units, fewer than n = {n_h[k]}")
        if replicates > n_h[k]:
            raise ValueError(f"stratum {k} takes {n_h[k]} units, fewer than replicates = {replicates}")
        if size and found[k]["t"] > 0 and found[k]["pos"] < n_h[k]:
            raise ValueError(f"stratum {k} has {found[k]['pos']} units of positive size, fewer than n = {n_h[k]}")
    design = Design(n_h, sizes, tuple(coords), strata, method, seed, size, replicates, tuple(balance or ()))

    flat = [k for k in levels if not size or found[k]["t"] <= 0]
    rows = frame.withColumn("_s", stratum).withColumn("_z", F.when(F.col("_s").isin(flat), F.lit(1.0)).otherwise(z))
    if size and len(flat) < len(levels):
        threshold = by_stratum(pps_thresholds(rows, F.col("_s"), "_z", n_h), F.col("_s"))
        return rows, F.when(F.col("_z") >= threshold, F.lit(1.0)).otherwise(F.col("_z") / threshold), design
    return rows, by_stratum({k: n_h[k] / sizes[k] for k in levels}, F.col("_s")), design


def select_units(
    frame: DataFrame,
    n,
    size: str | None = None,
    coords: list[str] | None = None,
    strata: str | None = None,
    method: str = "lpm",
    replicates: int = 1,
    seed: int = 1,
    balance: list[str] | None = None,
    levels: list[str] | None = None,
) -> Sample:
    """Draw a sample. SRS and systematic are plain DataFrame plans; local pivotal and cube draws run in blocks along the
    Hilbert curve, a task each. Strata in ``levels`` order, or sorted."""
    rows, p, design = prepared(frame, n, size, coords, strata, method, replicates, seed, balance, levels)
    rows, coords, seed, replicates = rows.withColumn("_p", p), list(design.coords), design.seed, design.replicates
    n_h, sizes, levels = design.n, design.sizes, list(design.n)
    seeds = by_stratum({k: seed * 100 + i for i, k in enumerate(levels, 1)}, F.col("_s"))

    if method == "srs":
        rows = rows.withColumn("_u", uniform(seeds, F.col("unit"))).withColumn("_n", by_stratum(n_h, F.col("_s"))).withColumn("_all", by_stratum(sizes, F.col("_s")))
        rows = lowest(rows, ["_s"], "_u", "unit", "_n", "_all").withColumnRenamed("chosen", "sampled").withColumn("pi", F.col("_n") / F.col("_all"))
    elif method == "systematic":
        rows = _systematic(rows, coords, n_h, seed, replicates, levels)
    else:
        rows = _sequential(rows, coords, method, balance or [], seed, sizes)
    return Sample(rows.drop("_s", "_z", "_p", "_u", "_n", "_all"), design)


def _systematic(rows: DataFrame, coords: list[str], n_h: dict[str, int], seed: int, replicates: int, levels: list[str]) -> DataFrame:
    span = rows.agg(*[f(c).alias(f"{f.__name__}_{i}") for i, c in enumerate(coords) for f in (F.min, F.max)]).first()
    top = (1 << HILBERT_BITS) - 1
    cell = [
        F.floor((F.col(c).cast("double") - float(span[f"min_{i}"])) / float(span[f"max_{i}"] - span[f"min_{i}"]) * top).cast("long") if span[f"max_{i}"] > span[f"min_{i}"] else F.lit(0).cast("long")
        for i, c in enumerate(coords)
    ]
    rows = rows.withColumn("_h", hilbert(*cell)).withColumn("_q", F.col("_p") / replicates)
    rows = running_total(rows, ["_s"], ["_h", "unit"], F.shiftright("_h", HILBERT_BITS), "_q", "_c")
    picks = []
    for k in range(replicates):
        # rounding keeps sums of many probabilities from drifting over a whole number
        start = by_stratum({s: (task_seed(seed * 100 + i, k) % (1 << 52) + 0.5) / (1 << 52) for i, s in enumerate(levels, 1)}, F.col("_s"))
        end, begin = F.round(F.col("_c"), 9), F.round(F.col("_c") - F.col("_q"), 9)
        picks.append(F.floor(end - start) > F.floor(begin - start))
    rows = rows.withColumn("in_replicate", F.array(*picks)).withColumn("sampled", F.array_contains("in_replicate", True))
    rows = rows.withColumn("pi", 1 - F.pow(1 - F.col("_q"), replicates))
    if replicates == 1:
        rows = rows.withColumn("pi", F.col("_p")).drop("in_replicate")
    else:
        rows = rows.withColumn("n_replicates", F.size(F.filter("in_replicate", lambda v: v))).withColumn("pi_replicate", F.col("_q"))
    return rows.drop("_h", "_q", "_c")


#: Units of a block that one task draws from.
BLOCK = 20_000


def _sequential(rows: DataFrame, coords: list[str], method: str, balance: list[str], seed: int, sizes: dict[str, int]) -> DataFrame:
    """Draws that are sequential by nature. A stratum is cut along the Hilbert curve into blocks of BLOCK units. Each block, a
    task, decides all of its units but the few that its own sums leave open: one of a pivotal draw, about as many as there
    are variables of a cube draw. One task per stratum then decides those. Probabilities, the sample's size and the
    balance are kept by every step, so they hold for the whole."""
    numbers = {k: i for i, k in enumerate(sizes, 1)}
    kind = dict(rows.dtypes)["unit"]
    columns = list(dict.fromkeys(["_s", "unit", "_p", *coords, *balance]))

    def sums(pdf: pd.DataFrame) -> np.ndarray:
        p = pdf["_p"].to_numpy(float)
        return np.column_stack([p, pdf[balance].to_numpy(float)]) if balance else p[:, None]

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit", kind="stable")
        s, p = task_seed(seed * 100 + numbers[key[0]]), pdf["_p"].to_numpy(float)
        open_p = pdf["_left"].to_numpy(float) if "_left" in pdf else p
        chosen = local_pivotal(pdf[coords].to_numpy(float), open_p, s) if method == "lpm" else cube(sums(pdf), p, s, open_p)
        return pdf.loc[chosen, ["unit"]]

    if max(sizes.values()) <= BLOCK:
        chosen = rows.select(*columns).groupBy("_s").applyInPandas(draw, f"unit {kind}")
    else:
        span = rows.agg(*[f(c).cast("double").alias(f"{f.__name__}_{i}") for i, c in enumerate(coords[:2]) for f in (F.min, F.max)]).first()
        top = (1 << HILBERT_BITS) - 1
        cell = [F.floor((F.col(c).cast("double") - span[f"min_{i}"]) / max(span[f"max_{i}"] - span[f"min_{i}"], 1e-300) * top).cast("long") for i, c in enumerate(coords[:2])]
        placed = rows.select(*columns, hilbert(*(cell if len(cell) > 1 else [cell[0], F.lit(0).cast("long")])).alias("_h"), F.lit(1).alias("_one"))
        placed = running_total(placed, ["_s"], ["_h", "unit"], F.shiftright("_h", HILBERT_BITS), "_one", "_n")
        placed = placed.withColumn("_block", F.floor((F.col("_n") - 1) / BLOCK)).select(*columns, "_block")

        def decide(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("unit", kind="stable")
            s, p = task_seed(seed * 100 + numbers[key[0]], "block", key[1]), pdf["_p"].to_numpy(float)
            left = pivotal_flight(pdf[coords].to_numpy(float), p, s) if method == "lpm" else cube_flight(sums(pdf), p, s)
            return pdf.assign(_left=left).loc[left > 0, [*columns, "_left"]]

        fields = ", ".join(f"`{c}` {t}" for c, t in placed.select(*columns).dtypes)
        decided = placed.groupBy("_s", "_block").applyInPandas(decide, f"{fields}, _left double").persist()
        last = decided.where("_left < 1").groupBy("_s").applyInPandas(draw, f"unit {kind}")
        chosen = decided.where("_left = 1").select("unit").unionByName(last)
    chosen = chosen.withColumnRenamed("unit", "_unit")
    out = rows.join(chosen, F.col("unit") == F.col("_unit"), "left").withColumn("sampled", F.col("_unit").isNotNull())
    return out.withColumn("pi", F.col("_p")).drop("_unit")
