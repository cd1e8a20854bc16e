"""Bounded samples of least hash, without every task sending its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

MORE = 1.5


def least_hash(rows: DataFrame, h: Column, sample: int) -> DataFrame:
    """At most ``sample`` rows of least hash h (a long, spread evenly), with it as ``_h``, in its order.

    Rows above a bound that the count gives are dropped where they are read, so
    about MORE times the sample are sorted, however many tasks there are. Where h
    repeats so much that the bound leaves too few rows, it is raised.
    """
    n = rows.count()
    share = MORE * sample / n if n > 4 * sample else 1.0
    some = rows
    while share < 1:
        some = rows.filter(h <= int(-(2.0**63) + share * 2.0**64))
        if some.count() >= sample:
            break
        some, share = rows, 4 * share
    return some.withColumn("_h", h).orderBy("_h").limit(sample)
