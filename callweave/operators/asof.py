"""As-of joins: for each left row the nearest earlier (or later) right row of the same key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.operators import scan


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    take: dict[str, str],
    tie: Sequence[str] = (),
    strict: bool = False,
    within_days: int | None = None,
    direction: str = "backward",
    bounded: bool = False,
) -> DataFrame:
    """Left join of the nearest right row by time, with ``take`` = {right column: output name}.

    Among right rows of one key and instant the greatest `tie` wins. `strict` leaves out equal
    instants. `within_days` drops matches further away. NULL keys never match. `bounded` says that both
    sides have few rows per key by construction.
    """
    by = list(by)
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction: {direction}")
    forward = direction == "forward"
    picked = F.struct(F.col(right_on).alias("_at"), *[F.col(c).alias(o) for c, o in take.items()])

    # one right row per key and instant, so equal keys cannot pile up in a scan
    source = right.filter(F.col(right_on).isNotNull())
    for k in by:
        source = source.filter(F.col(k).isNotNull())
    best = F.max_by("_hit", F.struct(*tie)) if tie else F.max("_hit")
    source = source.withColumn("_hit", picked).groupBy(*by, F.col(right_on).alias("_t")).agg(best.alias("_hit"))

    def time_order(late_side: str) -> list[Column]:
        when = F.col("_t").desc() if forward else F.col("_t").asc()
        return [when, F.col(late_side)]

    left_side, right_side = (0, 1) if strict else (1, 0)
    hit_type = source.schema["_hit"].dataType
    right_rows = source.withColumn("_side", F.lit(right_side))

    if bounded:
        packed = left.select(
            *by, F.col(left_on).alias("_t"), F.struct(*left.columns).alias("_row"), F.lit(left_side).alias("_side")
        )
        both = packed.unionByName(right_rows, allowMissingColumns=True)
        upto = (
            Window.partitionBy(*by)
            .orderBy(*time_order("_side"))
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        matched = (
            both.withColumn("_found", F.last("_hit", ignorenulls=True).over(upto))
            .filter(F.col("_row").isNotNull())
            .select("_row.*", "_found", "_t")
        )
    else:
        # scan distinct instants only, then join the answer back to the full rows
        instants = left.select(*by, F.col(left_on).alias("_t")).distinct().withColumns(
            {"_side": F.lit(left_side), "_hit": F.lit(None).cast(hit_type)}
        )
        both = instants.unionByName(right_rows)
        found = scan.running(both, by, time_order("_side"), _found=scan.latest(F.col("_hit")))
        found = found.filter(F.col("_side") == left_side).select(
            *[F.col(k).alias(f"_f_{k}") for k in by], F.col("_t"), "_found"
        )
        match = F.col(left_on) == F.col("_t")
        for k in by:
            match = match & (F.col(k) == F.col(f"_f_{k}"))
        matched = left.join(found, match, "left").select(*left.columns, "_found", F.col(left_on).alias("_t"))

    near = F.col("_t").isNotNull()
    for k in by:
        near = near & F.col(k).isNotNull()
    if within_days is not None:
        distance = F.abs(F.unix_micros(F.col("_t").cast("timestamp")) - F.unix_micros(F.col("_found._at").cast("timestamp")))
        near = near & (distance <= within_days * 86_400_000_000)
    return matched.select(
        *left.columns, *[F.when(near, F.col(f"_found.{o}")).alias(o) for o in take.values()]
    )
