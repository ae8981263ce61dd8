"""Resume of interrupted runs. The inputs are batch tables; there are no streams to follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators import scan


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return items.join(done.select(key), key, "left_anti")


def resume_index(items: DataFrame, done: DataFrame, key: str, order: str) -> DataFrame:
    """0-based place of the first item that is not done, or the item count when all are."""
    placed = scan.running(items, [], [F.col(order)], _rn=scan.rows())
    open_items = pending(placed, done, key)
    total = items.agg(F.count(F.lit(1))).scalar()
    return open_items.agg(F.coalesce(F.min("_rn") - 1, total).alias("resume_index"))
