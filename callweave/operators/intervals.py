"""Joins of points with intervals that share an equality key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"
DATE_SPAN = ("1900-01-01", "2100-01-01")


def _cells(value: Column, width: int, floor: Column, ceiling: Column) -> Column:
    return F.floor(F.greatest(F.least(value, ceiling), floor) / width)


def interval_join(
    points: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    at: str,
    low: str,
    high: str,
    how: str = "inner",
    width: int = 1826,
    floor: int | None = None,
    ceiling: int | None = None,
) -> DataFrame:
    """Join where the keys are equal and ``low <= at <= high``; a NULL high means open.

    The point axis (a DATE or an integer) is cut into cells of `width`; a span is listed under
    each cell it touches and a point under exactly one, so every pair meets once and the equi
    join on (keys, cell) compares only neighbours. Clipping to [floor, ceiling] bounds the number
    of cells of a span and is exact, since the range itself is tested again.
    """
    dated = dict(points.dtypes)[at] == "date"
    if dated:
        def axis(c: Column) -> Column:
            return F.unix_date(c)
        lo, hi = (F.unix_date(F.lit(d).cast("date")) for d in DATE_SPAN)
        open_end: Column = F.lit(OPEN_END).cast("date")
    else:
        def axis(c: Column) -> Column:
            return c.cast("long")
        if floor is None or ceiling is None:
            raise ValueError("an integer axis needs floor and ceiling, which bound the cells of an open span")
        lo, hi = F.lit(floor), F.lit(ceiling)
        open_end = F.lit(2**62)
    end = F.coalesce(F.col(high), open_end)
    listed = (
        spans.filter(F.col(low).isNotNull() & (F.col(low) <= end))
        .withColumn("_end", end)
        .withColumn(
            "_cell",
            F.explode(F.sequence(_cells(axis(F.col(low)), width, lo, hi), _cells(axis(F.col("_end")), width, lo, hi))),
        )
        .withColumnsRenamed({k: f"_r_{k}" for k in keys})
        .withColumnsRenamed({low: "_low"} if low in points.columns else {})
    )
    low_name = "_low" if low in points.columns else low
    placed = points.withColumn("_point_cell", _cells(axis(F.col(at)), width, lo, hi))
    match = (F.col("_point_cell") == F.col("_cell")) & F.col(at).between(F.col(low_name), F.col("_end"))
    for k in keys:
        match = match & (F.col(k) == F.col(f"_r_{k}"))
    joined = placed.join(listed, match, how)
    drop = ["_point_cell", "_cell", "_end", "_low", *[f"_r_{k}" for k in keys]]
    return joined.drop(*drop) if low_name == low else joined.drop(*drop)
