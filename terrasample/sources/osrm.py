"""Travel tables from an OSRM server, block by block."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasample.functions.checks import no_rows, requires
from terrasample.operators.travel import TravelMatrix

Fetch = Callable[[str], dict]


def http_fetch(url: str) -> dict:
    with urllib.request.urlopen(url, timeout=60) as answer:  # noqa: S310
        return json.load(answer)


def table_url(server: str, profile: str, measure: str, rows: pd.DataFrame, columns: pd.DataFrame) -> str:
    both = pd.concat([rows, columns])
    place = ";".join(f"{lon:.6f},{lat:.6f}" for lon, lat in zip(both["lon"], both["lat"], strict=True))
    n = len(rows)
    index = lambda a, b: ";".join(map(str, range(a, b)))
    return f"{server.rstrip('/')}/table/v1/{profile}/{place}?sources={index(0, n)}&destinations={index(n, len(both))}&annotations={measure}"


def osrm_table(points: DataFrame, measure: str = "duration", server: str = "http://127.0.0.1:5000", profile: str = "driving", block: int = 100, fetch: Fetch = http_fetch) -> tuple[TravelMatrix, DataFrame]:
    """Travel between all pairs of ``unit, lat, lon`` points, and how far each was moved onto the road network.

    Requests are block x block; each is a row of a small task table, so they run on the executors in parallel. Units that
    the server cannot reach are an error that names them.
    """
    requires(points, ["unit", "lat", "lon"], "the points")
    if measure not in ("duration", "distance"):
        raise ValueError("measure must be duration or distance")
    spark = points.sparkSession
    # the tasks carry the points of their blocks: a matrix's units are few by definition
    pdf = points.select("unit", "lat", "lon").toPandas().reset_index(drop=True)
    blocks = [pdf.iloc[a : a + block].to_dict("list") for a in range(0, len(pdf), block)]
    tasks = spark.createDataFrame([(i, j, json.dumps({"rows": r, "columns": c})) for i, r in enumerate(blocks) for j, c in enumerate(blocks)], "i int, j int, task string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for j, text in zip(part["j"], part["task"], strict=True):
                task = json.loads(text)
                rows, columns = pd.DataFrame(task["rows"]), pd.DataFrame(task["columns"])
                answer = fetch(table_url(server, profile, measure, rows, columns))
                if answer.get("code") != "Ok":
                    raise RuntimeError(f"the server answered {answer.get('code')}: {answer.get('message', '')}")
                values = answer["durations" if measure == "duration" else "distances"]
                snaps = [s.get("distance") for s in answer["sources"]]
                scale = 1 / 60 if measure == "duration" else 1 / 1000
                for name, snap, line in zip(rows["unit"], snaps, values, strict=True):
                    yield pd.DataFrame({"from": name, "to": columns["unit"], "travel": [None if v is None else v * scale for v in line], "snap": snap if j == 0 else None})

    out = tasks.repartition(max(1, len(blocks) ** 2)).mapInPandas(run, "`from` string, `to` string, travel double, snap double").persist()
    no_rows(out.where("travel is null or isnan(travel)").select(F.explode(F.array("from", "to")).alias("unit")), "units that the server cannot reach")
    travel = out.select("from", "to", F.when(F.col("from") == F.col("to"), 0.0).otherwise(F.greatest("travel", F.lit(0.0))).alias("travel"))
    snap = out.where("snap is not null").groupBy(F.col("from").alias("unit")).agg(F.max("snap").alias("snap"))
    return TravelMatrix(travel, points, "osrm", "min" if measure == "duration" else "km", 1.0, ("lat", "lon")), snap
