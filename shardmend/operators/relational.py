"""Relational helpers: islands, range joins, first match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], start: str, end: str, order: list[str] | None = None) -> DataFrame:
    """df with `island`: ranges of a key that touch or overlap share a number. One window for the running end, one for the count."""
    w = Window.partitionBy(*keys).orderBy(start, *(order or [end]))
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_new", (before.isNull() | (F.col(start) > before)).cast("int")).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def range_join(points: DataFrame, ranges: DataFrame, keys: list[str], point: str, start: str, end: str, width: int, inclusive: bool = False) -> DataFrame:
    """points with the ranges that hold them, by an equi-join on keys and buckets of `width`.

    A range is listed once for each bucket it touches, so width should be near the usual range's length.
    Never a nested loop, and the shuffle spreads over the buckets of a hot key.
    """
    last = F.col(end) - (0 if inclusive else 1)
    spread = ranges.where(last >= F.col(start)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(last / width))))
    inside = (F.col(point) >= F.col(start)) & (F.col(point) <= F.col(end) if inclusive else F.col(point) < F.col(end))
    return points.withColumn("_b", F.floor(F.col(point) / width)).join(spread, [*keys, "_b"]).where(inside).drop("_b")


def first_match(df: DataFrame, keys: list[str], order: str | Column, columns: list[str]) -> DataFrame:
    """Of each key, the columns of the row with the least order: an aggregation with partial results."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("_m")).select(*keys, "_m.*")
