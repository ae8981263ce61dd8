"""Non-linear reduction of vectors: the spectral layout of their neighbour graph.

Each key's nearest neighbours (`knn_graph`, on unit vectors) are weighted exp(-d^2 / (s_a s_b)), with s the distance to a point's last
neighbour. The coordinates are the leading eigenvectors of the normalised adjacency D^-1/2 W D^-1/2 after the trivial one, divided by
the root of the degree and damped by the eigenvalue's power `TIME`, as in a diffusion of so many steps: points are near that many
short paths join, on curved sheets too, and parts of the graph that are not joined lie apart.

A key of `leaf` points at most is solved densely in one task. Larger keys are iterated together: a block of columns is multiplied by (I + D^-1/2 W
D^-1/2) / 2 in sparse joins (a point meets the list of its links; its products are summed before they are shuffled), made orthonormal from its Gram matrix, summed where the rows are and factorised once
a key, and rotated by the Rayleigh-Ritz problem in the end. What a key sends on is a matrix of (dims + 2)^2 numbers.

The sign of every axis makes its largest coordinate positive. Copies share their place. Points without a vector have null coordinates; a point alone in its key
lies at the origin.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions import vectors
from callweave.operators import knn_graph
from callweave.session import materialize

NEIGHBORS = 15
TIME = 4
ROUNDS = 6
STEPS = 4
SENT_LINKS = 1 << 21
SENT_ROWS = 1 << 16


def affinities(edges: DataFrame) -> DataFrame:
    """Symmetric weights (a, b, weight) of a neighbour graph, listed both ways."""
    scale = edges.groupBy("a").agg(F.max("distance").alias("scale"))
    both = edges.select("a", "b", "distance").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    pairs = both.groupBy("a", "b").agg(F.max("distance").alias("distance"))
    met = pairs.join(scale, "a").join(scale.select(F.col("a").alias("b"), F.col("scale").alias("other")), "b")
    squared = F.try_divide(F.col("distance") * F.col("distance"), F.col("scale") * F.col("other"))
    return met.select("a", "b", F.exp(-F.coalesce(squared, F.lit(0.0))).alias("weight"))


def _signed(v: np.ndarray) -> np.ndarray:
    return v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)


def _coordinates(values: np.ndarray, columns: np.ndarray, degree: np.ndarray, dims: int) -> np.ndarray:
    """Diffusion coordinates from eigenvalues (falling) and eigenvectors of the normalised adjacency, the trivial one first."""
    kept = min(dims, columns.shape[1] - 1)
    out = np.zeros((len(columns), dims))
    spread = columns[:, 1 : kept + 1] / np.sqrt(degree)[:, None] * np.sqrt(degree.sum())
    out[:, :kept] = _signed(spread * np.clip(values[1 : kept + 1], 0, 1) ** TIME)
    return out


def _dense(dims: int) -> Callable[[pa.Table], pa.Table]:
    def solved(part: pa.Table) -> pa.Table:
        a, b, weight = (part.column(c).to_numpy() for c in ("a", "b", "weight"))
        nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        w = np.zeros((len(nodes), len(nodes)))
        w[ends[: len(a)], ends[len(a) :]] = weight
        degree = w.sum(axis=1)
        values, columns = np.linalg.eigh(w / np.sqrt(degree[:, None] * degree[None]))
        # the trivial vector first, also where parts of the graph share its eigenvalue
        trivial = np.sqrt(degree / degree.sum())
        top = columns[:, ::-1][:, : dims + 1]
        rest = top - np.outer(trivial, trivial @ top)
        u, s, _ = np.linalg.svd(rest, full_matrices=False)
        basis = np.column_stack([trivial, u[:, s > 1e-6][:, :dims]])
        small = basis.T @ (w / np.sqrt(degree[:, None] * degree[None])) @ basis
        small[0, 1:] = small[1:, 0] = 0
        order, turn = np.linalg.eigh(small[1:, 1:])
        basis[:, 1:] = basis[:, 1:] @ turn[:, ::-1]
        found = _coordinates(np.r_[1.0, order[::-1]], basis, degree, dims)
        return pa.Table.from_pydict({"node": nodes, "reduced": pa.array(list(found), pa.list_(pa.float64()))})

    return solved


def _listed(links: DataFrame) -> DataFrame:
    """Links (scope, a, b, weight) as one row a column of the matrix: scope, node, and the ids and weights of its links."""
    lists = [F.collect_list("a").alias("ids"), F.collect_list("weight").alias("weights")]
    return links.groupBy("scope", F.col("b").alias("node")).agg(*lists)


def _summed(held: list[pa.RecordBatch], width: int):
    """Products of the rows' links with their block rows, summed by the node that they go to."""
    part = {c: pa.concat_arrays([b.column(c) for b in held]) for c in ("scope", "ids", "weights", "x")}
    row = np.repeat(np.arange(len(part["ids"])), part["ids"].value_lengths().to_numpy())
    weight, x = part["weights"].flatten().to_numpy(), part["x"].flatten().to_numpy().reshape(-1, width).T.copy()
    nodes, place = np.unique(part["ids"].flatten().to_numpy(), return_inverse=True)
    scope = np.empty(len(nodes), np.int64)
    scope[place] = part["scope"].to_numpy()[row]
    out = [np.bincount(place, weight * x[c][row], len(nodes)) for c in range(width)]
    columns = {"scope": scope, "node": nodes, **{f"x{c}": out[c] for c in range(width)}}
    for low in range(0, len(nodes), SENT_ROWS):
        yield pa.RecordBatch.from_pydict({name: column[low : low + SENT_ROWS] for name, column in columns.items()})


def _sent(width: int):
    """Sums of some SENT_LINKS links at a time."""

    def run(batches):
        held, links = [], 0
        for batch in filter(len, batches):
            held.append(batch)
            links += len(batch.column("ids").flatten())
            if links >= SENT_LINKS:
                yield from _summed(held, width)
                held, links = [], 0
        if held:
            yield from _summed(held, width)

    return run


def _times(x: DataFrame, links: DataFrame, width: int) -> DataFrame:
    """The links' matrix times the block; the block is read once, so that a chain of steps is no longer than its steps."""
    lists = links if "ids" in links.columns else _listed(links)
    met = lists.join(x.select("node", "x"), "node").select("scope", "ids", "weights", "x")
    sums = [f"x{c}" for c in range(width)]
    sent = met.mapInArrow(_sent(width), f"scope long, node long, {', '.join(f'{c} double' for c in sums)}")
    return sent.groupBy("scope", "node").agg(F.array(*[F.sum(c) for c in sums]).alias("x"))


def _lazy(links: DataFrame, degree: DataFrame) -> DataFrame:
    """(I + D^-1/2 W D^-1/2) / 2 as links (scope, a, b, weight), the diagonal among them."""
    other = degree.select(F.col("node").alias("b"), F.col("degree").alias("other"))
    met = links.join(degree.withColumnRenamed("node", "a"), "a").join(other, "b")
    beside = met.select("scope", "a", "b", (F.col("weight") / F.sqrt(F.col("degree") * F.col("other")) / 2).alias("weight"))
    return beside.unionAll(degree.select("scope", F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.5).alias("weight")))


def _gram(left: DataFrame, y: str, width: int, name: str) -> DataFrame:
    cells = [F.sum(F.col("x")[i] * F.col(y)[j]) for i in range(width) for j in range(width)]
    return left.groupBy("scope").agg(F.array(*cells).alias(name))


def _by_scope(grams: DataFrame, solve: Callable[[np.ndarray], np.ndarray], width: int) -> DataFrame:
    """A matrix per scope from its Gram matrix; scopes come in batches."""

    @F.pandas_udf("array<double>")
    def solved(cells):
        return cells.map(lambda c: solve(np.array(c).reshape(width, width)).ravel())

    return materialize(grams.select("scope", solved("gram").alias("turn")))


def _turned(x: DataFrame, turns: DataFrame, width: int) -> DataFrame:
    """The block times its scope's matrix; a matrix written out term by term is more code than the JVM compiles."""
    places = F.sequence(F.lit(0), F.lit(width - 1))
    columns = [F.transform(places, lambda i: F.get("turn", i * width + j)) for j in range(width)]
    return x.join(turns, "scope").select("scope", "node", F.array(*[vectors.dot(F.col("x"), c) for c in columns]).alias("x"))


def _orthonormal(gram: np.ndarray) -> np.ndarray:
    values, turn = np.linalg.eigh((gram + gram.T) / 2)
    return turn / np.sqrt(np.maximum(values, values.max() * 1e-12))


def _ritz(gram: np.ndarray) -> np.ndarray:
    """Rotation to the eigenvectors, the leading ones first."""
    _, turn = np.linalg.eigh((gram + gram.T) / 2)
    return turn[:, ::-1]


def _iterated(points: DataFrame, weights: DataFrame, dims: int) -> DataFrame:
    """node and reduced of large scopes by block power iteration."""
    width = dims + 2
    summed = weights.groupBy("a").agg(F.sum("weight").alias("degree")).withColumnRenamed("a", "node")
    degree = materialize(points.select("scope", "node").join(summed, "node").select("scope", "node", "degree"))
    links = materialize(_listed(_lazy(weights, degree)))
    # the first column is the trivial vector; a few directions of the vectors are a smooth start for the rest
    rng = np.random.default_rng(42)
    starts = points.mapInArrow(knn_graph.projected(rng.normal(size=(1, width - 1, knn_graph.width(points)))), knn_graph.PRODUCTS)
    column = F.concat(F.array(F.lit(1.0)), F.col("p")[0])
    x = starts.join(degree.select("node", "degree"), "node").select("scope", "node", F.transform(column, lambda v: v * F.sqrt("degree")).alias("x"))
    for _ in range(ROUNDS):
        x = _turned(x, _by_scope(_gram(x, "x", width, "gram"), _orthonormal, width), width)
        for _ in range(STEPS):
            x = _times(x, links, width)
        x = materialize(x)
    x = materialize(_turned(x, _by_scope(_gram(x, "x", width, "gram"), _orthonormal, width), width))
    y = _times(x, links, width).select("node", F.col("x").alias("y"))
    inner = x.join(y, "node")
    x = materialize(_turned(x, _by_scope(_gram(inner, "y", width, "gram"), _ritz, width), width))
    inner = x.join(_times(x, links, width).select("node", F.col("x").alias("y")), "node").join(degree.select("node", "degree"), "node")
    value = [F.sum(F.col("x")[i] * F.col("y")[i]) * 2 - 1 for i in range(width)]
    peak = [F.max_by(F.col("x")[i], F.abs(F.col("x")[i] / F.sqrt("degree"))) for i in range(width)]
    facts = materialize(inner.groupBy("scope").agg(F.array(*value).alias("values"), F.array(*peak).alias("peaks"), F.sum("degree").alias("total")))
    axis = lambda i: (
        F.col("x")[i] / F.sqrt("degree") * F.sqrt("total") * F.pow(F.least(F.greatest(F.col("values")[i], F.lit(0.0)), F.lit(1.0)), TIME)
        * F.when(F.col("peaks")[i] < 0, -1.0).otherwise(1.0)
    )
    return x.join(degree.select("node", "degree"), "node").join(facts, "scope").select("node", F.array(*[axis(i) for i in range(1, dims + 1)]).alias("reduced"))


def layout(
    points: DataFrame, keys: Sequence[str], item: str, vector: str, dims: int, neighbors: int = NEIGHBORS, leaf: int = knn_graph.LEAF
) -> DataFrame:
    """keys, item and `reduced`, `dims` coordinates inside each key, of vectors of one length."""
    unit = points.select(*keys, item, vectors.unit(F.col(vector)).alias("unit"))
    placed = knn_graph.placed(unit, keys, item, "unit")
    first = knn_graph.heads(placed)
    weights = affinities(knn_graph.graph(first, neighbors, leaf=leaf))
    sizes = first.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    listed = materialize(weights.join(first.select(F.col("node").alias("a"), "scope"), "a").join(sizes, "scope"))
    small = listed.filter(F.col("n") <= leaf).groupBy("scope").applyInArrow(_dense(dims), "node long, reduced array<double>")
    many = materialize(listed.filter(F.col("n") > leaf).select("a", "b", "weight"))
    large = first.join(sizes.filter(F.col("n") > leaf), "scope", "left_semi")
    found = small if many.isEmpty() else small.unionAll(_iterated(large, many, dims))
    of_all = knn_graph.to_heads(placed, first).join(found.withColumnRenamed("node", "head"), "head").select("node", "reduced")
    origin = F.when(F.col("vector").isNotNull(), F.array_repeat(F.lit(0.0), dims))
    return placed.join(of_all, "node", "left").select(*keys, item, F.coalesce("reduced", origin).alias("reduced"))
