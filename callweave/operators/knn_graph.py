"""Nearest-neighbour graph of the points of each key, for keys of any size.

A forest of random-projection trees deals the points of a key into cells of `leaf` points at most: a round cuts every larger cell
at the medians of three random directions, in one aggregation and one join for all cells of all keys and trees. Neighbours are
found exactly inside each cell, and the cells of several trees are merged, so that what one tree cuts apart another
holds together. Then neighbours of neighbours are compared twice: the k points of a list are each other's candidates, which is a
bounded number of pairs a point; only pairs that are not farther than a point's last neighbour are sent on. A key that fits in one cell
has one tree and exact neighbours. While the trees are cut, points carry products with the directions, not their vectors.

Copies of one vector would fill each other's lists, so the graph is drawn over `heads`, one point of each vector with its
number of copies. Points of equal projections go to both sides of a cut by a hash. Points without a vector have no neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.session import materialize

TREES = 6
LEAF = 1024
CUTS = 3
SLACK = 4
ROUNDS = 2
DEPTH = 20
AMONG_ROWS = 256
AMONG_CELLS = 1 << 18
EDGE = "a long, b long, distance double"
PRODUCTS = "scope long, node long, p array<array<double>>"
NEAREST = "a long, ids array<long>, far array<double>"


def placed(points: DataFrame, keys: Sequence[str], item: str, vector: str) -> DataFrame:
    """Stored points with a number (`node`), the number of their key (`scope`) and a vector of doubles."""
    plain = points.select(*keys, item, F.col(vector).cast("array<double>").alias("vector"))
    if not keys:
        return materialize(plain.withColumns({"scope": F.lit(0).cast("long"), "node": F.monotonically_increasing_id()}))
    scopes = materialize(points.select(*keys).distinct().withColumn("scope", F.monotonically_increasing_id()))
    left, right = plain.alias("l"), scopes.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    joined = left.join(right, same, "left").select("l.*", "r.scope")
    return materialize(joined.withColumn("node", F.monotonically_increasing_id()))


def heads(points: DataFrame) -> DataFrame:
    """One stored point (the least node) of each vector of a scope, with the number of its copies."""
    known = points.filter("vector IS NOT NULL").groupBy("scope", "vector")
    return materialize(known.agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("copies")))


def to_heads(points: DataFrame, first: DataFrame) -> DataFrame:
    """scope, node and head of every point that has a vector."""
    return points.join(first.select("scope", "vector", F.col("node").alias("head")), ["scope", "vector"]).select("scope", "node", "head")


def projected(directions: np.ndarray):
    """Products of the vectors with each tree's directions (trees, number, size), summed in the order of the components."""

    def run(batches):
        for batch in filter(len, batches):
            vectors = batch.column("vector").flatten()
            x = vectors.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            products = np.zeros((batch.num_rows, *directions.shape[:2]))
            for i in range(x.shape[1]):
                products += x[:, i, None, None] * directions[:, :, i]
            none = np.asarray(vectors.is_null()).reshape(x.shape).any(axis=1)
            flat = pa.array(products.ravel(), mask=np.repeat(none, products[0].size) if none.any() else None)
            ends = [np.arange(0, n + 1, step, dtype=np.int32) for n, step in ((len(flat), products.shape[2]), (batch.num_rows * len(directions), len(directions)))]
            p = pa.ListArray.from_arrays(ends[1], pa.ListArray.from_arrays(ends[0], flat))
            yield pa.RecordBatch.from_arrays([batch.column("scope"), batch.column("node"), p], ["scope", "node", "p"])

    return run


def width(points: DataFrame) -> int:
    """Number of components of the vectors, which all have as many."""
    return points.agg(F.max(F.size("vector"))).first()[0] or 1


def cells(points: DataFrame, trees: int = TREES, leaf: int = LEAF, seed: int = 42) -> DataFrame:
    """tree, scope and path (the cell) of the points; the smaller keys, of one cell, have one tree."""
    known = points.filter("vector IS NOT NULL").select("scope", "node", "vector")
    counts = known.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.agg(F.max("n")).first()[0] or 0
    if largest <= leaf:
        return known.withColumns({"tree": F.lit(0), "path": F.lit(0).cast("long")})
    listed = F.when(F.col("n") > leaf, F.sequence(F.lit(0), F.lit(trees - 1))).otherwise(F.array(F.lit(0)))
    cell, size = ["tree", "scope", "path"], width(known)
    rng = np.random.default_rng(seed)
    levels = 1 + math.ceil(math.log(largest / leaf, 1 << CUTS))  # as many as even cuts take, and one to see it
    dealt = None
    for depth in range(DEPTH):
        level = depth % levels
        if level == 0:
            # the products of the next levels in one pass; a point carries these numbers from cell to cell
            directions = np.stack([rng.normal(size=(trees, size)) for _ in range(levels * CUTS)], axis=1)
            made = known.mapInArrow(projected(directions), PRODUCTS)
            if dealt is None:
                dealt = made.join(counts, "scope").select("scope", "node", "p", F.explode(listed).alias("tree"), F.lit(0).cast("long").alias("path"))
            else:
                dealt = dealt.drop("p").join(made.select("node", "p"), "node")
            dealt = dealt.withColumn("p", F.get("p", F.col("tree")))
        names = [f"p{c}" for c in range(CUTS)]
        cut = dealt.withColumns({n: F.get("p", F.lit(level * CUTS + c)) for c, n in enumerate(names)})
        medians = [F.percentile_approx(n, F.lit(0.5), F.lit(1000)).alias(f"m{n}") for n in names]
        large = materialize(cut.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), *medians).filter(F.col("n") > leaf))
        if large.isEmpty():
            break
        sides = F.lit(0).cast("long")
        for c, n in enumerate(names):
            coin = F.shiftright(F.xxhash64("node", F.lit(depth)), c).bitwiseAND(F.lit(1)) == 1
            above = (F.col(n) > F.col(f"m{n}")) | ((F.col(n) == F.col(f"m{n}")) & coin)
            sides = sides + above.cast("long") * (1 << c)
        moved = F.when(F.col("n").isNull(), F.col("path")).otherwise(F.col("path") * (1 << CUTS) + sides + 1)
        dealt = materialize(cut.join(large, cell, "left").select("scope", "node", "p", "tree", moved.alias("path")))
    return dealt.drop("p").join(known.select("node", "vector"), "node").select("scope", "node", "vector", "tree", "path")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 0)


def _in_cell(k: int):
    def nearest(cell: pa.Table) -> pa.Table:
        nodes, x = cell.column("node").to_numpy(), _matrix(cell.column("vector"))
        order = np.argsort(nodes)
        nodes, x = nodes[order], x[order]
        n, near = len(nodes), min(k, len(nodes) - 1)
        if near < 1:
            return pa.Table.from_pydict({"a": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "far": pa.array([], pa.list_(pa.float64()))})
        x = x - x.mean(axis=0)
        squares, wide = (x * x).sum(axis=1), min(near + SLACK, n - 1)  # rounded distances choose, exact ones decide
        ids, far = [], []
        for low in range(0, n, 512):
            part = slice(low, min(low + 512, n))
            d = squares[part, None] + squares[None, :] - 2 * x[part] @ x.T
            d[np.arange(part.stop - low), np.arange(low, part.stop)] = np.inf
            few = np.argpartition(d, wide - 1, axis=1)[:, :wide]
            exact = np.sqrt(((x[part][:, None, :] - x[few]) ** 2).sum(axis=2))
            best = np.lexsort((few, exact), axis=1)[:, :near]
            ids.append(np.take_along_axis(few, best, axis=1))
            far.append(np.take_along_axis(exact, best, axis=1))
        found, distance = nodes[np.concatenate(ids).ravel()], np.concatenate(far).ravel()
        ends = np.arange(0, len(found) + 1, near, dtype=np.int32)
        return pa.Table.from_pydict({"a": nodes, "ids": pa.ListArray.from_arrays(ends, found), "far": pa.ListArray.from_arrays(ends, distance)})

    return nearest


def _merged(k: int):
    """The k nearest of each point from its lists, one of each tree, as edges."""

    def run(batches):
        for batch in batches:
            row = np.repeat(np.arange(batch.num_rows), batch.column("ids").value_lengths().to_numpy())
            b, distance = batch.column("ids").flatten().to_numpy(), batch.column("far").flatten().to_numpy()
            order = np.lexsort((distance, b, row))
            first = order[np.r_[True, (row[order][1:] != row[order][:-1]) | (b[order][1:] != b[order][:-1])][: len(row)]]
            order = first[np.lexsort((b[first], distance[first], row[first]))]
            place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
            kept = order[place < k]
            yield pa.RecordBatch.from_pydict({"a": batch.column("a").to_numpy()[row[kept]], "b": b[kept], "distance": distance[kept]})

    return run


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each point, each pair once."""
    pairs = edges.groupBy("a", "b").agg(F.min("distance").alias("distance"))
    ranked = pairs.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy("distance", "b")))
    return ranked.filter(F.col("place") <= k).drop("place")


def _among(batches):
    """Distances between all points of one list, as far as the points reach; what is held and sent on is that of AMONG_ROWS lists."""
    for batch in batches:
        for low in range(0, batch.num_rows, AMONG_ROWS):
            part = batch.slice(low, AMONG_ROWS)
            sizes = part.column("ids").value_lengths().to_numpy()
            starts = np.cumsum(sizes) - sizes
            nodes = part.column("ids").flatten().to_numpy()
            vectors = part.column("vectors").flatten().flatten().to_numpy().reshape(len(nodes), -1)
            reach = part.column("reach").flatten().to_numpy() if "reach" in part.schema.names else np.full(len(nodes), np.inf)
            rows = {"a": [nodes[:0]], "b": [nodes[:0]], "distance": [reach[:0]]}
            for size in np.unique(sizes):
                i, j = np.triu_indices(size, 1)
                lists, step = starts[sizes == size], max(1, AMONG_CELLS // max(1, len(i) * vectors.shape[1]))
                for few in (lists[at : at + step, None] + np.arange(size) for at in range(0, len(lists), step)):
                    x, far, ids = vectors[few], reach[few], nodes[few]
                    d = np.sqrt(((np.take(x, i, axis=1) - np.take(x, j, axis=1)) ** 2).sum(axis=2))
                    for one, other in ((i, j), (j, i)):
                        near = ~(d > far[:, one])
                        rows["a"].append(ids[:, one][near])
                        rows["b"].append(ids[:, other][near])
                        rows["distance"].append(d[near])
            yield pa.RecordBatch.from_pydict({c: np.concatenate(v) for c, v in rows.items()})


def graph(points: DataFrame, k: int, trees: int = TREES, leaf: int = LEAF, rounds: int = ROUNDS) -> DataFrame:
    """The k nearest neighbours of every point (scope, node, vector), inside its scope: a, b, distance (stored)."""
    if k >= leaf:
        raise ValueError(f"a cell of {leaf} points has no {k} neighbours for each")
    dealt = cells(points, trees, leaf)
    found = dealt.groupBy("tree", "scope", "path").applyInArrow(_in_cell(k), NEAREST)
    lists = found.groupBy("a").agg(F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("far")).alias("far"))  # one a tree
    edges = materialize(lists.mapInArrow(_merged(k), EDGE))
    many = points.filter("vector IS NOT NULL").groupBy("scope").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > leaf)
    large = points.join(many, "scope", "left_semi").select(F.col("node").alias("b"), "vector")
    for _ in range(rounds if not many.isEmpty() else 0):
        # a pair farther than a full list's last neighbour cannot enter the list
        last = F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(F.lit(float("inf")))
        reach = edges.groupBy(F.col("a").alias("b")).agg(last.alias("reach"))
        wide = large.join(reach, "b", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
        lists = edges.join(wide, "b").groupBy("a").agg(*[F.collect_list(c).alias(n) for c, n in (("b", "ids"), ("vector", "vectors"), ("reach", "reach"))])
        edges = materialize(_best(edges.unionAll(lists.select("ids", "vectors", "reach").mapInArrow(_among, EDGE)), k))
    return edges
