"""Column expressions: permanent random numbers, distances, a Hilbert index."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius in kilometres.
EARTH_KM = 6371.0
#: Bits per axis of the Hilbert index.
HILBERT_BITS = 16


def uniform(*parts: Column | str | int) -> Column:
    """A permanent random number strictly between 0 and 1: 52 bits of the MD5 of the parts joined by colons."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digits = F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in columns])), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def euclidean(a: Column, b: Column, a2: Column, b2: Column) -> Column:
    return F.sqrt((a - a2) * (a - a2) + (b - b2) * (b - b2))


def haversine(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    rad = math.pi / 180
    s, t = F.sin((lat2 - lat) * rad / 2), F.sin((lon2 - lon) * rad / 2)
    h = s * s + F.cos(lat * rad) * F.cos(lat2 * rad) * t * t
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def hilbert(x: Column, y: Column, bits: int = HILBERT_BITS) -> Column:
    """Place of integer grid coordinates (0 to 2^bits - 1) along a Hilbert curve."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(acc: Column, s: Column) -> Column:
        rx = F.when(acc["x"].bitwiseAND(s) > 0, 1).otherwise(0).cast("long")
        ry = F.when(acc["y"].bitwiseAND(s) > 0, 1).otherwise(0).cast("long")
        d = acc["d"] + s * s * ((3 * rx).bitwiseXOR(ry))
        flip = (ry == 0) & (rx == 1)
        fx = F.when(flip, s - 1 - acc["x"].bitwiseAND(s - 1)).otherwise(acc["x"].bitwiseAND(s - 1))
        fy = F.when(flip, s - 1 - acc["y"].bitwiseAND(s - 1)).otherwise(acc["y"].bitwiseAND(s - 1))
        turn = ry == 0
        return F.struct(F.when(turn, fy).otherwise(fx).alias("x"), F.when(turn, fx).otherwise(fy).alias("y"), d.cast("long").alias("d"))

    steps = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, -1, -1)])
    return F.aggregate(steps, start, step)["d"]
