"""Exact top-k by inner product as a Voronoi kNN join.

The greatest inner products become the least distances when every candidate gets one more coordinate,
sqrt(M^2 - |x|^2) with M the largest norm, and every query a zero: |q - x|^2 = |q|^2 + M^2 - 2 q.x.

Candidates and queries are assigned to their nearest pivot. A summary per pivot holds the count and the k+1 least
distances of its candidates (one of them may be the query's own row). For a cell of queries with radius U around p_i, the
k+1 smallest of U + |p_i p_j| + |p_j x| over the summaries bound the distance theta of the k-th neighbour, and a
candidate of p_j can matter only if its distance to p_j lies within |p_i p_j| +- (U + theta). Query cells near each
other are put together into groups of about `group_queries` queries, so that a candidate is replicated to a group once.

A group's candidates are dealt by hash to blocks of about `block_rows`, its queries (in parts, where a single cell exceeds
`group_queries`) go to each of its blocks, the block products are solved locally in numpy, and the best k per query and block
are ranked once more. No task holds more than a block and a part, whatever the cell.

Vectors are quantised to floor(scale * x), and scores are exact integers (64-bit). Vectors that are null or
hold null, NaN or infinite components take no part, nor do rows without an identifier. Shorter vectors count as padded with zeros.
Rows that repeat are separate rows, each a candidate of the other. Ties go to the smaller identifier.
Empty tables give empty results, and further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.shared import table
from callweave.session import materialize

SCALE = 256.0
PIVOTS = 64
GROUP_QUERIES = 2048
BLOCK_ROWS = 8192
QUERIES_AT_ONCE = 256
EXACT = 2.0**53
SLACK = 1e-6


@dataclass(frozen=True)
class Space:
    """What the tasks need to place a vector: padded pivots (with their extra coordinate) and the largest norm."""

    pivots: np.ndarray
    top: float


def quantised(vectors: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """(vec_id, v array<long>) of the rows that take part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return vectors.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).filter(sound).select(
        F.col(vec_id).alias("vec_id"), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v")
    )


def padded(rows: pd.Series, width: int) -> np.ndarray:
    """Lists of whole numbers as one block, with zeros behind the shorter ones."""
    out = np.zeros((len(rows), width), dtype=np.int64)
    for at, row in enumerate(rows):
        out[at, : len(row)] = row
    return out


def _norm(column: Column) -> Column:
    return F.aggregate(column, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))


def space(points: DataFrame, pivots: int) -> Space:
    """Pivots: the vectors of least hash among those given, equal ones once."""
    width, top = points.agg(F.max(F.size("v")), F.max(_norm(F.col("v")))).first()
    drawn = points.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(pivots).collect()
    block = padded(pd.Series([r[0] for r in drawn]), width).astype(float)
    return Space(_lifted(block, float(top)), float(top))


def _lifted(block: np.ndarray, top: float) -> np.ndarray:
    extra = np.sqrt(np.maximum(top - np.einsum("ij,ij->i", block, block), 0.0))
    return np.column_stack([block, extra])


def _nearest(lifted: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot and the distance to it; the distance itself is summed from differences."""
    rough = (pivots**2).sum(axis=1) - 2 * lifted @ pivots.T
    cell = rough.argmin(axis=1)
    return cell, np.sqrt(((lifted - pivots[cell]) ** 2).sum(axis=1))


def placed(points: DataFrame, where: Space, is_query: Column) -> DataFrame:
    """Every point with its cell and distance as a candidate, and as a query where it is one. Stored with row numbers."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = where.pivots.shape[1] - 1
        for batch in batches:
            block = padded(batch["v"], width).astype(float)
            batch["cell"], batch["far"] = _nearest(_lifted(block, where.top), where.pivots)
            batch["query_cell"], batch["query_far"] = _nearest(np.column_stack([block, np.zeros(len(block))]), where.pivots)
            yield batch

    schema = "vec_id long, v array<long>, is_query boolean, cell int, far double, query_cell int, query_far double"
    marked = points.select("vec_id", "v", is_query.alias("is_query"))
    return materialize(marked.mapInPandas(place, schema).withColumn("row", F.monotonically_increasing_id()))


def bounds(points: DataFrame, where: Space, k: int, group_queries: int, block_rows: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(group, cell, low, high, blocks, parts) for candidates, (query_cell, group, blocks, parts) for queries.

    Works on the summaries alone: k+1 numbers per pivot, one row per query cell.
    """
    ranked = Window.partitionBy("cell").orderBy("far")
    least = (
        points.select("cell", "far").withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= k + 1)
        .groupBy("cell").agg(F.collect_list("far").alias("least"))
    )
    counted = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    cells = counted.join(least, "cell").toPandas()
    asked = points.filter("is_query").groupBy("query_cell").agg(F.max("query_far").alias("radius"), F.count(F.lit(1)).alias("n")).toPandas()
    gaps = np.sqrt(((where.pivots[:, None, :] - where.pivots[None, :, :]) ** 2).sum(axis=2))
    slack = SLACK * (1 + np.sqrt(where.top))

    low, high = {}, {}
    for i, radius in zip(asked["query_cell"], asked["radius"], strict=True):
        reach = np.sort(np.concatenate([radius + gaps[i, j] + np.array(d) for j, d in zip(cells["cell"], cells["least"], strict=True)]))
        theta = reach[k] if len(reach) > k else np.inf
        for j in cells["cell"]:
            low[i, j], high[i, j] = gaps[i, j] - radius - theta - slack, gaps[i, j] + radius + theta + slack

    grouped = _grouped(asked, gaps, group_queries)
    rows = []
    for group in sorted(set(grouped.values())):
        own = [i for i in grouped if grouped[i] == group]
        rows += [(group, j, min(low[i, j] for i in own), max(high[i, j] for i in own)) for j in cells["cell"]]
    reached = pd.DataFrame(rows, columns=["group", "cell", "low", "high"])
    sizes = reached.merge(cells[["cell", "n"]], on="cell")
    nearest, farthest = points.agg(F.min("far"), F.max("far")).first() if rows else (0.0, 0.0)
    sizes = sizes[(sizes["high"] >= nearest) & (sizes["low"] <= farthest)]
    blocks = (-(-sizes.groupby("group")["n"].sum() // block_rows)).clip(lower=1).rename("blocks").astype("int64")
    queries = pd.DataFrame(grouped.items(), columns=["query_cell", "group"]).merge(asked[["query_cell", "n"]], on="query_cell")
    parts = (-(-queries.groupby("group")["n"].sum() // group_queries)).rename("parts").astype("int64")
    cuts = pd.concat([blocks, parts], axis=1)
    reached = reached.merge(cuts, left_on="group", right_index=True)
    return reached, queries.drop(columns="n").merge(cuts, left_on="group", right_index=True)


def _grouped(asked: pd.DataFrame, gaps: np.ndarray, group_queries: int) -> dict[int, int]:
    """Query cells put together along a chain of near pivots until a group is full."""
    left = dict(zip(asked["query_cell"].astype(int), asked["n"], strict=True))
    out: dict[int, int] = {}
    group, filled, at = 0, 0, min(left, default=0)
    while left:
        at = min(left, key=lambda j: (gaps[at, j], j))
        n = left.pop(at)
        if filled and filled + n > group_queries:
            group, filled = group + 1, 0
        out[at] = group
        filled += n
    return out


def top_k(
    vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding", scale: float = SCALE,
    pivots: int = PIVOTS, group_queries: int = GROUP_QUERIES, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score of the `k` highest inner products of each query row with all other rows.

    `is_query` is a condition on `vec_id`.
    """
    spark = vectors.sparkSession
    points = materialize(quantised(vectors, vec_id, vector, scale))
    result = "query_id long, rank int, vec_id long, score long"
    if points.isEmpty():
        return spark.createDataFrame([], result)
    where = space(points, pivots)
    points = placed(points, where, is_query)
    reached, queries = bounds(points, where, k, group_queries, block_rows)
    if queries.empty:
        return spark.createDataFrame([], result)

    # (groups x pivots) and (pivots) rows; Spark weighs them itself
    near = spark.createDataFrame(reached, "group int, cell int, low double, high double, blocks long, parts long")
    homes = spark.createDataFrame(queries, "query_cell int, group int, blocks long, parts long")
    candidates = (
        points.join(near, "cell").filter(F.col("far").between(F.col("low"), F.col("high")))
        .select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
                F.pmod(F.xxhash64("row"), "blocks").alias("block"), "row", "vec_id", "v")
    )
    asked = points.filter("is_query").join(homes, "query_cell").select(
        "group", F.pmod(F.xxhash64("row"), "parts").alias("part"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
        F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("query_v"),
    )
    width = where.pivots.shape[1] - 1

    def solve(queries_in: pd.DataFrame, candidates_in: pd.DataFrame) -> pd.DataFrame:
        return _best(queries_in, candidates_in, k, width)

    found = (
        asked.groupBy("group", "part", "block").cogroup(candidates.groupBy("group", "part", "block"))
        .applyInPandas(solve, "query_row long, query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _best(asked: pd.DataFrame, candidates: pd.DataFrame, k: int, width: int) -> pd.DataFrame:
    """The best k candidates of each query within one block."""
    candidates = candidates.sort_values("vec_id", kind="stable")
    block = padded(candidates["v"], width)
    ids, rows = candidates["vec_id"].to_numpy(), candidates["row"].to_numpy()
    n = len(ids)
    out = []
    for a in range(0, len(asked) if n else 0, QUERIES_AT_ONCE):
        some = asked.iloc[a : a + QUERIES_AT_ONCE]
        scores = _products(padded(some["query_v"], width), block)
        own = rows[None, :] == some["query_row"].to_numpy()[:, None]
        best = _first(scores, own, min(k, n))
        at = np.repeat(np.arange(len(some)), best.shape[1])
        keep = ~own[at, best.ravel()]
        at, best = at[keep], best.ravel()[keep]
        out.append((some["query_row"].to_numpy()[at], some["query_id"].to_numpy()[at], ids[best], scores[at, best]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
    return pd.DataFrame(dict(zip(["query_row", "query_id", "vec_id", "score"], columns, strict=True)))


def _products(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point where no sum can leave the exact range."""
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(block).max(initial=0)) * max(queries.shape[1], 1)
    if largest < EXACT:
        return (queries.astype(float) @ block.T.astype(float)).astype(np.int64)
    return queries @ block.T


def _first(scores: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest scores per row, earlier columns first among equals, own rows last."""
    n = scores.shape[1]
    if float(np.abs(scores).max()) < 2.0**62 / n:
        keys = scores * n - np.arange(n)
        keys[own] = np.iinfo(np.int64).min
        return np.argpartition(keys, n - k, axis=1)[:, n - k :]
    return np.lexsort((np.broadcast_to(np.arange(n), scores.shape), -scores.astype(float), own), axis=1)[:, :k]


def op6_voronoi_knn(spark, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, 5)


ORACLE = """
    WITH v AS (
        SELECT vec_id, row_number() OVER () AS r, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS e
        FROM embeddings
        WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
    scored AS (
        SELECT q.vec_id AS query_id, q.r AS query_row, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
        FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS rank FROM scored)
    WHERE rank <= 5
"""
