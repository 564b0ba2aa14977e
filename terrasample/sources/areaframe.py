"""Area frames from Parquet, GeoJSON and WKB, and results back onto geometries."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasample.functions.checks import no_rows, requires
from terrasample.functions.columns import EARTH_KM


def area_frame(cells: DataFrame, geometry: bool = False) -> DataFrame:
    """Cells of an exported area frame: ``unit`` ('c' and the cell's index), ``lat, lon``, ``area`` in square kilometres,
    then all other columns; the geometry only if asked for."""
    requires(cells, ["cell_index", "centroid_lon", "centroid_lat"], "the area frame")
    used = {"cell_index", "centroid_lon", "centroid_lat", "area_m2", "geom_wkb"}
    area = [(F.col("area_m2") / 1e6).alias("area")] if "area_m2" in cells.columns else []
    shape = ["geom_wkb"] if geometry and "geom_wkb" in cells.columns else []
    rest = [c for c in cells.columns if c not in used]
    return cells.select(F.concat(F.lit("c"), F.col("cell_index").cast("string")).alias("unit"), F.col("centroid_lat").alias("lat"), F.col("centroid_lon").alias("lon"), *area, *rest, *shape)


def read_areaframe(spark: SparkSession, path: str, geometry: bool = False) -> DataFrame:
    """Read a frame by its ending: Parquet as exported, or GeoJSON (centroids and areas)."""
    if path.lower().rstrip("/").endswith((".geojson", ".json")):
        return read_geojson(spark, path)
    return area_frame(spark.read.parquet(path), geometry)


def _rings(coordinates, kind: str) -> list[list[np.ndarray]]:
    if kind == "Polygon":
        return [[np.asarray(r, dtype=float)[:, :2] for r in coordinates]]
    return [[np.asarray(r, dtype=float)[:, :2] for r in polygon] for polygon in coordinates]


def centroid_area(polygons: list[list[np.ndarray]]) -> tuple[float, float, float]:
    """Longitude and latitude of the centroid, and square kilometres, of polygons in degrees: the plane formulas in a
    cylindrical equal-area projection about the polygon."""
    total, cx, cy = 0.0, 0.0, 0.0
    rad = math.pi / 180
    for rings in polygons:
        for n, ring in enumerate(rings):
            x, y = ring[:, 0] * rad, np.sin(ring[:, 1] * rad)
            cross = x * np.roll(y, -1) - np.roll(x, -1) * y
            area = abs(cross.sum()) / 2
            if area == 0:
                continue
            gx, gy = ((x + np.roll(x, -1)) * cross).sum() / (3 * cross.sum()), ((y + np.roll(y, -1)) * cross).sum() / (3 * cross.sum())
            sign = 1 if n == 0 else -1  # later rings are holes
            total, cx, cy = total + sign * area, cx + sign * area * gx, cy + sign * area * gy
    if total == 0:
        points = np.concatenate([r for rings in polygons for r in rings])
        return float(points[:, 0].mean()), float(points[:, 1].mean()), 0.0
    return cx / total / rad, math.asin(max(-1.0, min(1.0, cy / total))) / rad, total * EARTH_KM**2


def read_wkb(data: bytes) -> tuple[str, list]:
    """Kind and coordinates of a WKB point, polygon or multipolygon."""

    def geometry(at: int) -> tuple[str, list, int]:
        order = "<" if data[at] == 1 else ">"
        (code,) = struct.unpack_from(order + "I", data, at + 1)
        dims = 2 + (code // 1000 in (1, 2, 3)) + (code // 1000 == 3) + bool(code & 0x80000000) + bool(code & 0x40000000)
        at += 5
        if code & 0x20000000:
            at += 4
        kind = (code & 0xFFFF) % 1000

        def points(at: int, n: int) -> tuple[np.ndarray, int]:
            flat = np.frombuffer(data, dtype=order + "f8", count=n * dims, offset=at)
            return flat.reshape(n, dims)[:, :2], at + 8 * n * dims

        if kind == 1:
            p, at = points(at, 1)
            return "Point", p[0].tolist(), at
        if kind == 3:
            (n,) = struct.unpack_from(order + "I", data, at)
            at, rings = at + 4, []
            for _ in range(n):
                (m,) = struct.unpack_from(order + "I", data, at)
                ring, at = points(at + 4, m)
                rings.append(ring)
            return "Polygon", rings, at
        if kind == 6:
            (n,) = struct.unpack_from(order + "I", data, at)
            at, parts = at + 4, []
            for _ in range(n):
                _, rings, at = geometry(at)
                parts.append(rings)
            return "MultiPolygon", parts, at
        raise ValueError(f"geometry kind {kind} is not supported")

    kind, coordinates, _ = geometry(0)
    return kind, coordinates


def as_frame(df: DataFrame, unit: str | None = None, geometry: str = "geom_wkb") -> DataFrame:
    """A frame from a table with WKB geometries in degrees: ``unit, lat, lon``, ``area`` for polygons, then the rest. A
    table without geometries comes back unchanged."""
    if geometry not in df.columns:
        return df
    from terrasample.operators.ordering import with_index

    named = df.withColumn("unit", F.col(unit).cast("string")) if unit else with_index(df, "unit").withColumn("unit", F.concat(F.lit("u"), F.col("unit").cast("string")))

    @F.pandas_udf("lat double, lon double, area double")
    def centre(shapes: pd.Series) -> pd.DataFrame:
        out = []
        for data in shapes:
            if data is None:
                out.append((None, None, None))
                continue
            kind, c = read_wkb(bytes(data))
            if kind == "Point":
                out.append((c[1], c[0], None))
            else:
                lon, lat, area = centroid_area(_rings(c, kind))
                out.append((lat, lon, area))
        return pd.DataFrame(out, columns=["lat", "lon", "area"])

    rest = [c for c in df.columns if c not in (geometry, unit, "unit", "lat", "lon", "area")]
    return named.withColumn("_c", centre(F.col(geometry))).select("unit", "_c.lat", "_c.lon", "_c.area", *rest)


def as_geometries(results: DataFrame, shapes: DataFrame, unit: str = "unit") -> DataFrame:
    """Results joined onto the geometries of their units; results' columns win."""
    requires(shapes, [unit], "the geometries")
    no_rows(results.join(shapes.select(F.col(unit).alias("unit")), "unit", "left_anti"), "units without a geometry")
    keep = [c for c in shapes.columns if c == unit or c not in results.columns]
    return results.join(shapes.select(*keep).withColumnRenamed(unit, "unit"), "unit", "left")


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A frame from a GeoJSON feature collection of points or polygons, which one task reads, or from ``lines`` of a feature
    each, which are split among tasks. A feature without a geometry has no coordinates."""
    if lines:
        features = spark.read.json(path).select(F.struct("geometry", "properties").alias("f"))
    else:
        features = spark.read.option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    props = features.schema["f"].dataType["properties"].dataType.names if "properties" in features.schema["f"].dataType.names else []
    rows = features.select(F.to_json("f.geometry").alias("_g"), *[F.col(f"f.properties.{p}").alias(p) for p in props])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for part in batches:
            found = []
            for text in part["_g"]:
                g = json.loads(text) if text else {}
                if not g.get("coordinates"):
                    found.append((None, None, None))
                    continue
                c = g["coordinates"]
                c = [json.loads(v) if isinstance(v, str) else v for v in c]
                if g["type"] == "Point":
                    found.append((float(c[1]), float(c[0]), None))
                else:
                    lon, lat, area = centroid_area(_rings(c, g["type"]))
                    found.append((lat, lon, area))
            part[["lat", "lon", "area"]] = pd.DataFrame(found, index=part.index, columns=["lat", "lon", "area"])
            yield part.drop(columns="_g")

    fields = [f"`{p}` {t}" for p, t in rows.dtypes[1:]]
    out = rows.mapInPandas(run, ", ".join([*fields, "lat double", "lon double", "area double"]))
    if "unit" not in props:
        from terrasample.operators.ordering import with_index

        out = with_index(out, "unit").withColumn("unit", F.concat(F.lit("u"), F.col("unit").cast("string")))
    return out.select("unit", "lat", "lon", "area", *[p for p in props if p != "unit"])


def zonal_shares(pixels: DataFrame, cell: str, value: str, sets: dict[str, list]) -> DataFrame:
    """Share of each cell's pixels whose class is in a set, by set."""
    return pixels.groupBy(cell).agg(*[F.avg(F.col(value).isin(list(v)).cast("double")).alias(k) for k, v in sets.items()])
