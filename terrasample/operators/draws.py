"""Many samples of one frame of any size in one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasample.functions.columns import HILBERT_BITS
from terrasample.operators import select
from terrasample.operators.ordering import running_total
from terrasample.operators.select import Design, prepared, task_seed
from terrasample.operators.simulate import hilbert_place
from terrasample.operators.spatial import cube, cube_flight, local_pivotal, pivotal_flight


def survivor(p: np.ndarray, seed: int) -> np.ndarray:
    """What a pivotal or cube flight leaves of units whose probabilities sum to 1 at most: one unit that holds the whole sum.
    Flights keep probabilities, so it is each unit with a chance in proportion to its own, in whatever order they fight."""
    upto = np.cumsum(p)
    out = np.zeros(len(p))
    if len(p) and upto[-1] > 1e-9:
        out[np.searchsorted(upto, np.random.default_rng(seed).random() * upto[-1], side="right")] = 1.0 if upto[-1] > 1 - 1e-9 else upto[-1]
    return out


def _in_order(rows: DataFrame, x: list[str]) -> DataFrame:
    """``rows`` with their place ``_h`` on the Hilbert curve and their number ``_n`` along it within the stratum, from 1."""
    span = rows.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in x[:2] for f in (F.min, F.max)]).first()
    low, high = (np.array([span[f"{f}_{c}"] for c in x[:2]] + [0.0] * (2 - len(x))) for f in ("min", "max"))

    def placed(batches):
        for pdf in batches:
            at = pdf[x[:2]].to_numpy(float)
            yield pdf.assign(_h=hilbert_place(at if len(x) > 1 else np.column_stack([at, np.zeros(len(at))]), low, high))

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    # a frame may be one file, whose rows one task would place
    rows = rows.repartition("unit").mapInPandas(placed, f"{fields}, _h long").withColumn("_one", F.lit(1))
    return running_total(rows, ["_s"], ["_h", "unit"], F.shiftright("_h", HILBERT_BITS), "_one", "_n")


def many_draws(
    frame: DataFrame, coords: list[str], grid: Sequence, seeds: Mapping[tuple[int, int], int], size: str | None = None, strata: str | None = None, method: str = "lpm", replicates: int = 1, y: str | None = None
) -> tuple[DataFrame, list[Design], list]:
    """Sampled units ``k, r, h, unit, x, y, p, member`` of a sample for each key (k, r) of ``seeds``, of size ``grid[k]``; the
    design of each size; and what makes ``p`` of a frame row, by size, from the columns ``_s`` and ``_z`` of ``prepared``.

    The frame is put in the order of the Hilbert curve once. SRS draws numbers along it, systematic samples step along it, and
    each block of local pivotal and cube draws is a task that decides all samples; what the blocks of one sample leave open
    is decided as in ``select_units``.
    """
    rows, designs, chances = frame, [], []
    for n in grid:
        rows, p, design = prepared(frame, n, size, coords, strata, method, replicates, 1)
        designs.append(design)
        chances.append(p)
    levels = list(designs[0].n)
    place = {h: i for i, h in enumerate(levels, 1)}
    kind = dict(rows.dtypes)["unit"]
    value = F.col(y).cast("double") if y else F.lit(None).cast("double")
    rows = rows.select("unit", "_s", *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(coords)], value.alias("_y"), *[p.alias(f"_p{k}") for k, p in enumerate(chances)])
    x = [f"_x{i}" for i in range(len(coords))]
    rows = _in_order(rows, x)
    schema = f"k int, r int, h string, unit {kind}, x array<double>, y double, p double, member array<boolean>"

    def found(pdf: pd.DataFrame, k: int, r: int, own: np.ndarray, member: np.ndarray | None = None) -> pd.DataFrame:
        some = pdf.iloc[own]
        member = np.ones((len(own), 1), dtype=bool) if member is None else member
        return pd.DataFrame({"k": k, "r": r, "h": some["_s"].to_numpy(), "unit": some["unit"].to_numpy(), "x": list(some[x].to_numpy(float)), "y": some["_y"].to_numpy(float), "p": some[f"_p{k}"].to_numpy(float), "member": list(member)})

    empty = pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    if method == "srs":
        spark = frame.sparkSession
        wanted = [(k, r, h, s, n, designs[k].sizes[h]) for (k, r), s in seeds.items() for h, n in designs[k].n.items()]
        tasks = spark.createDataFrame(wanted, "k int, r int, h string, seed long, n long, size long").repartition(min(len(wanted), 64), "k", "r", "h")

        def numbers(batches):
            for part in batches:
                for t in part.itertuples():
                    at = np.random.default_rng(task_seed(t.seed, place[t.h])).choice(t.size, t.n, replace=False) + 1
                    yield pd.DataFrame({"k": t.k, "r": t.r, "h": t.h, "i": at})

        drawn = tasks.mapInPandas(numbers, "k int, r int, h string, i long")
        p = F.coalesce(*[F.when(F.col("k") == k, F.col(f"_p{k}")) for k in range(len(grid))])
        drawn = drawn.join(rows, (F.col("i") == F.col("_n")) & (F.col("h") == F.col("_s")))
        drawn = drawn.select("k", "r", "h", "unit", F.array(*x).alias("x"), F.col("_y").alias("y"), p.alias("p"), F.array(F.lit(True)).alias("member"))
        return drawn, designs, chances

    if method == "systematic":
        for k in range(len(grid)):
            rows = running_total(rows.withColumn("_q", F.col(f"_p{k}") / replicates), ["_s"], ["_h", "unit"], F.shiftright("_h", HILBERT_BITS), "_q", f"_c{k}")

        def steps(batches):
            for pdf in batches:
                at = pdf["_s"].map(place).to_numpy()
                for (k, r), s in seeds.items():
                    upto = pdf[f"_c{k}"].to_numpy(float)
                    end, begin = np.round(upto, 9), np.round(upto - pdf[f"_p{k}"].to_numpy(float) / replicates, 9)
                    starts = np.array([[(task_seed(s * 100 + i, m) % (1 << 52) + 0.5) / (1 << 52) for m in range(replicates)] for i in place.values()])[at - 1]
                    member = np.floor(end[:, None] - starts) > np.floor(begin[:, None] - starts)
                    own = np.flatnonzero(member.any(1))
                    if len(own):
                        yield found(pdf, k, r, own, member[own])

        return rows.mapInPandas(steps, schema), designs, chances

    flight = pivotal_flight if method == "lpm" else lambda x, p, s: cube_flight(p[:, None], p, s)

    def decide(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit", kind="stable")
        at, out = pdf[x].to_numpy(float), []
        for (k, r), s in seeds.items():
            p, own = pdf[f"_p{k}"].to_numpy(float), task_seed(s * 100 + place[key[0]], "block", key[1])
            left = survivor(p, own) if p.sum() <= 1 else flight(at, p, own)
            some = np.flatnonzero(left > 0)
            if len(some):
                out.append(found(pdf, k, r, some).assign(left=left[some]))
        return pd.concat(out) if out else empty.assign(left=[])

    def last(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit", kind="stable", ignore_index=True)
        k, r, h = key
        at, left = np.flatnonzero(pdf["left"] < 1), pdf["left"].to_numpy(float)
        some, s = pdf.iloc[at], task_seed(seeds[k, r] * 100 + place[h])
        if method == "lpm":
            kept = local_pivotal(np.array(some["x"].tolist(), dtype=float).reshape(len(some), len(x)), left[at], s)
        else:
            kept = cube(some[["p"]].to_numpy(float), some["p"].to_numpy(float), s, left[at])
        return pdf.drop(index=at[~kept], columns="left")

    block = F.floor((F.col("_n") - 1) / select.BLOCK)
    opened = rows.withColumn("_block", block).groupBy("_s", "_block").applyInPandas(decide, f"{schema}, left double")
    return opened.groupBy("k", "r", "h").applyInPandas(last, schema), designs, chances
