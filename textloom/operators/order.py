"""Ordinals of rows over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of a range, and most ranges; beyond, ranges are longer and their sorts may spill.
ROWS, MOST_RANGES = 100_000, 10_000


def ordinals(df: DataFrame, key: str, name: str = "ordinal", rows: int = ROWS) -> DataFrame:
    """df with 0-based places in ascending order of a numeric, unique key: ranges of about ``rows`` keys, counted, then numbered inside."""
    n = df.count()
    k = max(1, min(MOST_RANGES, -(-n // rows)))
    bounds = sorted(set(df.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / k for i in range(1, k)], 0.2 / k))) if k > 1 else []
    out = df.withColumn("_range", searched(bounds, F.col(key).cast("double")))
    sizes = out.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    base = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return out.withColumn("_inside", inside).join(F.broadcast(base), "_range").withColumn(name, (F.col("_inside") + F.col("_base")).cast("long")).drop("_range", "_inside", "_base")


def searched(bounds: list[float], value: Column, lo: int = 0, hi: int | None = None) -> Column:
    """Number of ascending bounds below the value, by halving: a tree of comparisons."""
    hi = len(bounds) if hi is None else hi
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(value > bounds[mid], searched(bounds, value, mid + 1, hi)).otherwise(searched(bounds, value, lo, mid))
