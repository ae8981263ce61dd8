"""Ordered scans inside groups that stay correct when one group is huge.

A Spark window sends a whole group to one task. The operators here sort globally by range instead,
scan each range on its own and add the totals carried over from the ranges before it, so no
task sees more than one range, whatever the group. Only where groups are bounded by
construction (`bounded=True`, say one row per permno and trading day) is a plain window used.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from callweave.session import materialize

BLOCK_ROWS = 100_000


@dataclass(frozen=True)
class Running:
    """One running value: `kind` is rows, total, product or latest."""

    kind: str
    column: Column | None = None


def rows() -> Running:
    return Running("rows")


def total(column: Column) -> Running:
    return Running("total", column)


def product(column: Column) -> Running:
    return Running("product", column)


def latest(column: Column) -> Running:
    """Last non-null value seen so far."""
    return Running("latest", column)


def _over(run: Running, ordered: WindowSpec) -> Column:
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if run.kind == "rows":
        return F.row_number().over(ordered).cast("long")
    if run.kind == "total":
        return F.sum(run.column).over(upto)
    if run.kind == "product":
        return F.product(run.column).over(upto)
    return F.last(run.column, ignorenulls=True).over(upto)


def _whole(run: Running, position: str) -> Column:
    if run.kind == "rows":
        return F.count(F.lit(1))
    if run.kind == "total":
        return F.sum(run.column)
    if run.kind == "product":
        return F.product(run.column)
    return F.max_by(run.column, F.when(run.column.isNotNull(), F.col(position)))


def _carried(run: Running, name: str, before: WindowSpec) -> Column:
    if run.kind in ("rows", "total"):
        return F.sum(name).over(before)
    if run.kind == "product":
        return F.product(F.col(name)).over(before)
    return F.last(name, ignorenulls=True).over(before)


def _combine(run: Running, carried: Column, local: Column) -> Column:
    if run.kind in ("rows", "total"):
        return F.when(carried.isNull(), local).otherwise(carried + F.coalesce(local, F.lit(0)))
    if run.kind == "product":
        return F.when(carried.isNull(), local).otherwise(carried * F.coalesce(local, F.lit(1.0)))
    return F.coalesce(local, carried)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bounded: bool = False,
    **outs: Running,
) -> DataFrame:
    """Add running values over `keys` in `order`, which must be a total order."""
    keys = list(keys)
    if bounded:
        ordered = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({n: _over(r, ordered) for n, r in outs.items()})

    by = [F.col(k) for k in keys] + list(order)
    placed = materialize(
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_pos", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_pos", 33))

    inside = Window.partitionBy(*keys, "_part").orderBy("_pos")
    before = (
        Window.partitionBy(*keys)
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # at most one row per key and range; only keys that span ranges stay
    carry = (
        placed.groupBy(*keys, "_part")
        .agg(*[_whole(r, "_pos").alias(n) for n, r in outs.items()])
        .withColumns({f"_c_{n}": _carried(r, n, before) for n, r in outs.items()})
        .withColumn("_seen", F.count(F.lit(1)).over(before))
        .filter("_seen > 0")
        .select(
            F.col("_part").alias("_cpart"),
            *[F.col(k).alias(f"_k_{k}") for k in keys],
            *[f"_c_{n}" for n in outs],
        )
    )
    local = placed.withColumns({n: _over(r, inside) for n, r in outs.items()})
    match = F.col("_part") == F.col("_cpart")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(carry, match, "left")
    return joined.withColumns(
        {n: _combine(r, F.col(f"_c_{n}"), F.col(n)) for n, r in outs.items()}
    ).select(*df.columns, *outs)


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    preceding: int,
    outs: dict[str, Callable[[WindowSpec, WindowSpec], Column]],
    bounded: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Values over the current row and up to `preceding` rows before it.

    Each `outs` entry gets the ordered window and the framed one. Groups are cut into
    blocks of rows that also carry the last `preceding` rows of the block before.
    """
    keys = list(keys)

    def evaluate(frame_df: DataFrame, ordered: WindowSpec) -> DataFrame:
        frame = ordered.rowsBetween(-preceding, Window.currentRow)
        return frame_df.withColumns({n: f(ordered, frame) for n, f in outs.items()})

    if bounded:
        return evaluate(df, Window.partitionBy(*keys).orderBy(*order))

    block = max(block_rows, preceding + 1)
    numbered = running(df, keys, order, _rn=rows())
    index = F.col("_rn") - 1
    own = F.floor(index / block)
    spill = F.pmod(index, F.lit(block)) >= block - preceding
    blocks = numbered.withColumn(
        "_b",
        F.explode(
            F.when(
                spill,
                F.array(
                    F.struct(own.alias("block"), F.lit(False).alias("halo")),
                    F.struct((own + 1).alias("block"), F.lit(True).alias("halo")),
                ),
            ).otherwise(F.array(F.struct(own.alias("block"), F.lit(False).alias("halo"))))
        ),
    ).select("*", F.col("_b.block").alias("_block"), F.col("_b.halo").alias("_halo"))
    done = evaluate(blocks, Window.partitionBy(*keys, "_block").orderBy("_rn"))
    return done.filter(~F.col("_halo")).select(*df.columns, *outs)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First `k` rows per group; the row-number filter is cut to `k` rows per task before
    the shuffle, so a huge group sends only a few rows on."""
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(out) <= k).withColumn(out, F.col(out).cast("long"))


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], bounded: bool = False
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, NULL values skipped.

    Equal values are counted before the shuffle and only the distinct ones are scanned, so
    no task holds a group's values in memory.
    """
    keys = list(keys)
    present = df.filter(F.col(value).isNotNull())
    counted = materialize(present.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")))
    scanned = running(counted, keys, [F.col(value)], bounded, _upto=total(F.col("_n")))
    sizes = counted.groupBy(*keys).agg(F.sum("_n").alias("_size")).select(
        "_size", *[F.col(k).alias(f"_s_{k}") for k in keys]
    )
    if keys:
        match = F.lit(True)
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
        sized = scanned.join(sizes, match)
    else:
        sized = scanned.withColumn("_size", counted.agg(F.sum("_n")).scalar())
    spots = {n: (F.col("_size") - 1) * F.lit(p) for n, p in probs.items()}
    picks = []
    for n, spot in spots.items():
        picks.append(F.min(F.when(F.col("_upto") > F.floor(spot), F.col(value))).alias(f"_lo_{n}"))
        picks.append(F.min(F.when(F.col("_upto") > F.ceil(spot), F.col(value))).alias(f"_hi_{n}"))
    found = sized.groupBy(*keys).agg(F.max("_size").alias("_size"), *picks)
    lows = {n: F.col(f"_lo_{n}") for n in probs}
    return found.select(
        *keys,
        *[
            (lows[n] + (F.col(f"_hi_{n}") - lows[n]) * (spot - F.floor(spot))).alias(n)
            for n, spot in spots.items()
        ],
    )


def ordered_lists(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: Column,
    out: str = "members",
    part_rows: int = 10_000,
    bounded: bool = False,
) -> DataFrame:
    """Ordered member lists, cut into parts of `part_rows` so that no list is unbounded.

    Groups up to `part_rows` give one row with part 0; larger ones continue in part 1, 2, ...
    """
    numbered = running(df.withColumn("_v", value), keys, order, bounded, _rn=rows())
    return (
        numbered.withColumn("part", F.floor((F.col("_rn") - 1) / part_rows))
        .groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list(F.struct("_rn", "_v"))).alias("_pairs"))
        .select(*keys, "part", F.col("_pairs._v").alias(out))
    )
