"""Rules that keep NULL handling the same as in the data-frame world."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_get(entries: Column, key: Column, default: Column) -> Column:
    """Value of a map under `key`, or the default where there is none."""
    return F.coalesce(F.try_element_at(entries, key), default)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column, done once at ingest."""
    floats = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in floats}) if floats else df


def finite_rows(df: DataFrame) -> DataFrame:
    """Rows without any NULL, NaN or infinite value."""
    keep = []
    for n, t in df.dtypes:
        keep.append(F.col(n).isNotNull())
        if t in ("double", "float"):
            keep.append(~F.isnan(n) & (F.abs(F.col(n)) != float("inf")))
    return df.filter(reduce(Column.__and__, keep))


def present_rows(df: DataFrame) -> DataFrame:
    """Rows without any NULL; NaN and infinities are values."""
    return df.filter(reduce(Column.__and__, [F.col(n).isNotNull() for n in df.columns]))


def ieee_divide(value: Column, by: Column) -> Column:
    """Quotient of floating numbers where division by zero gives an infinity, and zero by zero NaN, as SQL engines on IEEE numbers do."""
    over_zero = F.when(F.isnan(value) | (value == 0), float("nan")).otherwise(F.signum(value) * float("inf"))
    return F.when(by == 0, F.when(value.isNotNull(), over_zero)).otherwise(F.try_divide(value, by))


def keyed(keys: list[str], value: Column) -> Column:
    """A windowed value that is NULL when a key is NULL, as such rows form no group."""
    return F.when(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]), value)


def with_columns(df: DataFrame, **types: str) -> DataFrame:
    """Add optional columns that the input lacks, as typed NULLs."""
    absent = {n: F.lit(None).cast(t) for n, t in types.items() if n not in df.columns}
    return df.withColumns(absent) if absent else df
