"""Exact nearest neighbours for many query vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions import vectors
from callweave.operators import scan
from callweave.session import materialize

# rows of a tile on either side: a block of similarities takes 8 bytes for each pair, 32 MB in all
TILE_ROWS = 2048
MOST_PIVOTS = 4096
SLACK = 1e-9


def _best(ids, sims: np.ndarray, query_ids, k: int) -> pd.DataFrame:
    """k best columns of each row of the similarity block, ties by smaller id."""
    ids = np.asarray(ids)
    order = np.argsort(ids, kind="stable")
    ids, sims = ids[order], sims[:, order]
    k = min(k, sims.shape[1])
    least = np.partition(sims, sims.shape[1] - k, axis=1)[:, -k]
    rows, columns = np.nonzero(sims >= least[:, None])  # k of each row and what ties with the last
    values = sims[rows, columns]
    order = np.lexsort((columns, -values, rows))
    rows, columns, values = rows[order], columns[order], values[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    kept = place < k
    return pd.DataFrame({"query_id": np.asarray(query_ids)[rows[kept]], "item_id": ids[columns[kept]], "similarity": values[kept]})


def _pivots(items: DataFrame, n: int) -> np.ndarray:
    """Vectors of the `n` items of least hash, each different."""
    rows = items.orderBy(F.xxhash64("item_id"), "item_id").limit(n).collect()
    return np.unique(np.array([r.v for r in rows]), axis=0)


def _tiled(items: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Stored items with the pivot nearest to each and their angle to it."""

    def placed(batches):
        for batch in batches:
            if len(batch):
                dots = np.stack(batch["v"]) @ pivots.T
                near = dots.argmax(axis=1)
                angle = np.arccos(np.clip(dots[np.arange(len(near)), near], -1, 1))
                yield batch.assign(pivot=near.astype(np.int32), angle=angle)

    return materialize(items.mapInPandas(placed, "item_id long, v array<double>, pivot int, angle double"))


def _reach(queries: DataFrame, pivots: np.ndarray, radius: np.ndarray, home: bool) -> DataFrame:
    """The tiles each query looks into: its home, or all others that may hold an item as near as its `floor`.

    No item of a tile is nearer to a query than the query's angle to the pivot less the tile's radius.
    """

    def reached(batches):
        for batch in batches:
            if not len(batch):
                continue
            dots = np.where(np.isfinite(radius)[None], np.stack(batch["u"]) @ pivots.T, -np.inf)
            own = dots.argmax(axis=1)
            if home:
                yield batch.assign(pivot=own.astype(np.int32))
                continue
            gap = np.arccos(np.clip(dots, -1, 1)) - radius[None]
            wanted = np.isfinite(dots) & (np.cos(np.clip(gap, 0, np.pi)) >= batch["floor"].to_numpy()[:, None] - SLACK)
            wanted[np.arange(len(own)), own] = False
            rows, tiles = np.nonzero(wanted)
            yield batch[["query_id", "u"]].iloc[rows].assign(pivot=tiles.astype(np.int32))

    given = queries if not home else queries.select("query_id", "u")
    return materialize(given.mapInPandas(reached, "query_id long, u array<double>, pivot int"))


def _met(asks: DataFrame, tiled: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """The k best items of each (query, tile); tiles are met in parts of `TILE_ROWS` rows on either side."""
    crowds = asks.groupBy("pivot").agg(F.count(F.lit(1)).alias("asks"))
    parts = sizes.join(crowds, "pivot").select(
        "pivot", F.ceil(F.col("n") / TILE_ROWS).alias("parts"), F.ceil(F.col("asks") / TILE_ROWS).alias("chunks")
    )

    def own(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(n))

    def all_of(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    tile = ["pivot", "part", "chunk"]
    left = asks.join(parts, "pivot").select("pivot", all_of("parts").alias("part"), own("query_id", "chunks").alias("chunk"), "query_id", "u")
    right = tiled.join(parts, "pivot").select("pivot", own("item_id", "parts").alias("part"), all_of("chunks").alias("chunk"), "item_id", "v")

    def compared(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(a) == 0 or len(b) == 0:
            return pd.DataFrame({"query_id": [], "item_id": [], "similarity": []})
        return _best(b["item_id"], np.stack(a["u"]) @ np.stack(b["v"]).T, a["query_id"], k)

    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInPandas(compared, "query_id long, item_id long, similarity double")


def nearest(queries: DataFrame, items: DataFrame, k: int, query: str, item: str, vector: str = "embedding") -> DataFrame:
    """The k most similar items of every query by cosine, exactly.

    Items are tiled by the nearest of at most `MOST_PIVOTS` pivots. A query first meets its nearest tile; the k-th similarity found there
    is its floor, and then it meets only the tiles whose bound reaches the floor. Items and queries move once a tile that needs them.
    """
    q = queries.select(F.col(query).cast("long").alias("query_id"), vectors.unit(F.col(vector)).alias("u"))
    q = q.filter(F.col("u").isNotNull())
    x = items.select(F.col(item).cast("long").alias("item_id"), vectors.unit(F.col(vector)).alias("v"))
    x = x.filter(F.col("v").isNotNull())
    n = x.count()
    order = [F.desc("similarity"), F.col("item_id")]
    if n <= TILE_ROWS:  # one tile
        tile = F.lit(0).alias("pivot")
        sizes = x.sparkSession.createDataFrame([(0, n)], "pivot int, n long")
        return scan.top_k(_met(q.select("query_id", "u", tile), x.select("item_id", "v", tile), sizes, k), ["query_id"], order, k)
    q, x = materialize(q), materialize(x)
    pivots = _pivots(x, min(MOST_PIVOTS, -(-n // TILE_ROWS)))
    tiled = _tiled(x, pivots)
    sizes = materialize(tiled.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")))
    radius = np.full(len(pivots), -np.inf)
    for r in sizes.collect():  # a row per pivot
        radius[r.pivot] = r.radius
    first = materialize(_met(_reach(q, pivots, radius, True), tiled, sizes, k))
    best = scan.top_k(first, ["query_id"], order, k)
    floors = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("similarity")).alias("floor"))
    asking = q.join(floors, "query_id", "left").select("query_id", "u", F.coalesce("floor", F.lit(-2.0)).alias("floor"))
    rest = _met(_reach(asking, pivots, radius, False), tiled, sizes, k)
    return scan.top_k(first.unionAll(rest), ["query_id"], order, k)
