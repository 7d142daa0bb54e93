"""Joins that no single key decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], limit: int = 100_000) -> DataFrame:
    """rows joined to keyed, a row per key with the number of its rows in _n: keys of more than ``limit`` rows are broadcast (at most a limit-th of all rows), so that no task gets them whole."""
    hot = keyed.filter(F.col("_n") > limit)
    if hot.isEmpty():
        return rows.join(keyed, on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keyed.filter(F.col("_n") <= limit), on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)
