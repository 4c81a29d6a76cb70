"""Prefix scans over one order per key, in one level or, for keys too long for one task, in two.

In two levels rows are dealt by key and range of the first order column. Each range is scanned by itself; one summary row a range carries on what the earlier
ranges of the key end with. So the largest task holds one range, and what is sorted by key alone is one row a range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def meet(df: DataFrame, book: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """df with the columns of book, which has one row a key; null keys meet."""
    names = {k: f"_book_{i}" for i, k in enumerate(keys)}
    book = book.withColumnsRenamed(names)
    return df.join(book, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(n)) for k, n in names.items())), how).drop(*names.values())


def running(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, how: str = "last", current: bool = True, width: float | None = None) -> DataFrame:
    """df with `name`: the last value that isn't null, or the greatest one, among the rows of its keys up to it (current: itself included) in ascending order.

    order: columns, the first one numeric and never null; they must tell rows with different values apart. width: of the ranges, two levels if given.
    """
    if how not in ("last", "max"):
        raise ValueError(f"unknown scan {how!r}")
    one = lambda c: F.last(c, ignorenulls=True) if how == "last" else F.max(c)
    end = Window.currentRow if current else -1
    if width is None:
        return df.withColumn(name, one(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)))
    parts = [*keys, "_range"]
    cells = df.withColumn("_range", F.floor(F.col(order[0]) / width))
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))) if how == "last" else F.max(value)
    sums = cells.groupBy(*parts).agg(last.alias("_own"))
    sums = sums.withColumn("_before", one("_own").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).drop("_own")
    rows = meet(cells, sums, parts)
    own = one(value).over(Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, end))
    both = F.coalesce(own, F.col("_before")) if how == "last" else F.greatest(own, F.col("_before"))
    return rows.withColumn(name, both).drop("_range", "_before")
