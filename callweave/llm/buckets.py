"""Components of the pairs that share a bucket and pass a test, without a row for every such pair.

Every row of a bucket is first compared with the bucket's least node. What is left in several components is dealt at random to
cells of sixteen rows, and rows outside the bucket's largest component are compared with those of other components in
their cell. Then cells grow sixteenfold until each bucket is one cell, so no pair of different components is left out in the end.

A row that has links to a share s of its bucket is joined to one of them when its cell holds some 1 / s rows; joined rows never
meet again. So a round makes some rows a node, whatever the size of the group, and rounds grow with its logarithm. Pairs that fail the
test in the join condition make no rows, but a bucket's rows that nothing links are held against all of it in the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.components import components
from callweave.session import materialize

CELL = 16
GROWTH = 16


def side(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"{c}_{name}") for c in rows.columns])


def shared_rows(rows: DataFrame, least: int = 2) -> DataFrame:
    """`rows` (key, node and more) of the buckets of `least` rows and more, with the `first` node and the number `n` of rows."""
    met = rows.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return rows.join(met, "key")


def connected(
    shared: DataFrame, facts: DataFrame, known: DataFrame, test: Column, once: Column, verified: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """(node, root) of the components of the links `known` (a, b) and of all pairs in a bucket that pass.

    `shared` is a stored table as of `shared_rows`, a node once a key; `facts` has a row per node. `test` sees the columns of
    `facts` with `_a` and `_b` behind their names, `once` those of `shared` too: it holds in one bucket at least of every pair that
    passes. `verified` returns those of the pairs (a, b) that are links, if the test only excludes.
    """
    tried = None

    def joined(met: DataFrame, roots: DataFrame) -> DataFrame:
        nonlocal tried
        pairs = met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
        fresh = materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        if verified:
            tried = materialize(fresh if tried is None else tried.unionAll(fresh))
            fresh = materialize(verified(fresh))
        return components(roots.unionAll(fresh)).select(F.col("node").alias("a"), F.col("root").alias("b"))

    star = shared.filter("first < node").select(F.col("first").alias("node_a"), F.col("node").alias("node_b")).distinct()
    roots = joined(star.join(side(facts, "a"), "node_a").join(side(facts, "b"), "node_b").filter(test), known)
    done, cell = 0, CELL
    while True:
        rest = materialize(_open_rows(shared.filter(F.col("n") > done), roots))
        widest = rest.agg(F.max("n")).first()[0]
        if widest is not None:
            place = F.pmod(F.xxhash64("node", "key", F.lit(cell)), F.ceil(F.col("n") / cell))
            dealt = rest.withColumn("cell", place).withColumn("out", F.col("root") != F.col("largest")).join(facts, "node")
            outside, everyone = side(dealt.filter("out"), "a"), side(dealt, "b")
            met = (F.col("key_a") == F.col("key_b")) & (F.col("cell_a") == F.col("cell_b")) & (F.col("root_a") != F.col("root_b"))
            ordered = ~F.col("out_b") | (F.col("node_a") < F.col("node_b"))
            roots = joined(outside.join(everyone, met & ordered & once & test), roots)
        if widest is None or widest <= cell:
            return roots.select(F.col("a").alias("node"), F.col("b").alias("root"))
        done, cell = cell, cell * GROWTH


def _open_rows(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components, with their `root` and the bucket's `largest` one."""
    named = roots.select(F.col("a").alias("node"), F.col("b").alias("root"))
    placed = shared.join(named, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("rows"))
    open_ = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.max_by("root", F.struct("rows", "root")).alias("largest")).filter("roots > 1")
    return placed.join(open_.select("key", "largest"), "key")
