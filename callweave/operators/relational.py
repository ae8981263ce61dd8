"""Small relational building blocks shared by the plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions import dates
from callweave.operators import scan


def in_list(df: DataFrame, column: str, ids: Sequence) -> DataFrame:
    return df.filter(F.col(column).isin(list(ids)))


def keep_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return df.join(ids.select(column), column, "left_semi")


def first_ids(df: DataFrame, column: str, n: int) -> DataFrame:
    """First n of the sorted distinct ids (the n-firm trial run)."""
    return df.select(column).distinct().orderBy(column).limit(n)


def between_dates(df: DataFrame, column: Column, start: str, end: str) -> DataFrame:
    """Both ends inclusive at midnight, so a later time on the end day is out; unparsed dates are out."""
    moment = dates.parse_timestamp(column.cast("string"))
    return df.filter(moment.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def without_role(df: DataFrame, column: str, role: str) -> DataFrame:
    """Drop rows of one speaker role, any case; rows without a role stay."""
    return df.filter(~F.lower(F.col(column)).eqNullSafe(F.lit(role.lower())))


def by_name(df: DataFrame, column: str, name: str, order: Sequence[str]) -> DataFrame:
    return df.filter(F.lower(F.col(column)) == name.lower()).orderBy(*order).limit(1)


def missing_from(df: DataFrame, known: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(known.select(*on), list(on), "left_anti")


def upsert_new(existing: DataFrame, incoming: DataFrame, on: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of `incoming` whose key is not stored yet, the first in `order` per key."""
    return latest_per_key(missing_from(incoming, existing, on), on, order)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return scan.top_k(df, keys, order, 1).drop("rank")


def count_children(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, out: str) -> DataFrame:
    """Children per parent, 0 when there is none; counted before the join."""
    counted = child.groupBy(F.col(child_key).alias("_child")).agg(F.count(F.lit(1)).alias("_n"))
    return (
        parent.join(counted, F.col(parent_key) == F.col("_child"), "left")
        .withColumn(out, F.coalesce("_n", F.lit(0)))
        .drop("_child", "_n")
    )


def pivot_sum(df: DataFrame, row: str, column: str, values: Sequence, amount: str) -> DataFrame:
    """Sum of `amount` by row and column value, absent cells 0."""
    return df.groupBy(row).pivot(column, list(values)).sum(amount).na.fill(0)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")
