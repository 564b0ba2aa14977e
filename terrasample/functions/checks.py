"""Argument and data checks. Data are checked in one aggregation per call."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def requires(df: DataFrame, columns: Iterable[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} needs the column{'s' * (len(missing) > 1)} {', '.join(missing)}")


def whole(x: float, what: str, least: int = 0) -> int:
    if isinstance(x, bool) or x is None or x != x or x != int(x) or x < least:
        raise ValueError(f"{what} must be a whole number of at least {least}")
    return int(x)


def exactly_one(**options) -> str:
    given = [k for k, v in options.items() if v is not None]
    if len(given) != 1:
        raise ValueError(f"give exactly one of {', '.join(options)}")
    return given[0]


def no_rows(df: DataFrame, message: str, column: str = "unit") -> None:
    """Fail and name up to five of the rows that should not be there."""
    found = [str(r[0]) for r in df.select(column).distinct().limit(6).collect()]
    if found:
        raise ValueError(f"{message}: {', '.join(found[:5])}{' and more' * (len(found) > 5)}")


def all_true(df: DataFrame, **conditions: tuple[Column, str]) -> None:
    """Fail with the message of the first condition that some row does not meet; a null does not meet it."""
    row = df.agg(*[F.bool_and(F.coalesce(c, F.lit(False))).alias(k) for k, (c, _) in conditions.items()]).first()
    for k, (_, message) in conditions.items():
        if row[k] is False:
            raise ValueError(message)


def distinct(df: DataFrame, column: str, message: str) -> None:
    no_rows(df.groupBy(column).count().where("count > 1"), message, column)
