"""Global order without a task that sees all rows: ranges of rows, and offsets over the few ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import cut

#: Rows of a range.
RANGE_ROWS = 200_000


def ranged(df: DataFrame, *order: str | Column, rows: int = RANGE_ROWS, count: int | None = None) -> DataFrame:
    """df written in ranges of ``order`` of about ``rows`` rows, with the range in _range; as many ranges as the counted rows ask for.

    count: the rows of df, where it is a written table already; else it is written first to be counted.
    """
    if count is None:
        df = cut(df, "rows")
        count = df.count()
    return cut(df.repartitionByRange(max(1, -(-count // rows)), *order).withColumn("_range", F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, column: str, name: str = "at", rows: int = RANGE_ROWS) -> DataFrame:
    """df with the 0-based place of each row in the order of ``column``, which is distinct."""
    placed = ranged(df, column, rows=rows)
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per range
    inside = F.row_number().over(W.partitionBy("_range").orderBy(column)) - 1
    return placed.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range").withColumn(name, (inside + F.col("_before")).cast("int")).drop("_range", "_before")
