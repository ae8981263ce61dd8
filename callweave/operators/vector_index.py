"""Inverted-file index of unit vectors with product-quantised residuals.

`build` fits coarse centroids and code books on a sample of at most `SAMPLE` rows (the lowest hashes of the item), then puts every row
in the list of its nearest centroid: the residual in one byte per subspace, and the whole vector for re-ranking. The index is a folder:
`lists` (Parquet, one folder per list), `centroids` and `books`. It is built after a load and read by any later session.

`search` compares a query with the centroids, looks into its `probes` nearest lists only, scores their rows by table look-ups
(cosine with the centroid plus the parts of the residual), and ranks the best `rerank` rows by their exact cosine. A list is read in parts of
`PART_ROWS` rows and asked by `PART_QUERIES` queries at a time, so a crowded list or a common query is many tasks. Centroids are at most
`MOST_LISTS` rows, which is what tasks get sent; with `probes` as many as there are lists and `rerank` as many as rows it is exact.

Rows without a vector, or whose vector has no length, are not in the index. Ties go to the smaller item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions import vectors
from callweave.operators import scan
from callweave.session import materialize

SAMPLE = 65_536
MOST_LISTS = 4_096
SUBSPACES = 16
CODES = 256
PROBES = 16
RERANK = 20
PART_ROWS = 50_000
PART_QUERIES = 2_048
ITERATIONS = 12


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's centres of a sample; an empty cluster starts again at the row that is furthest from its centre."""
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ITERATIONS):
        label, gap = _closest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x)
        counts = np.bincount(label, minlength=k)
        empty = np.flatnonzero(counts == 0)
        centres = sums / np.maximum(counts, 1)[:, None]
        centres[empty] = x[np.argsort(-gap)[: len(empty)]]
    return centres


def _closest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    label, gap = np.zeros(len(x), np.int64), np.zeros(len(x))
    squares = (centres * centres).sum(axis=1)
    for low in range(0, len(x), 4096):
        part = x[low : low + 4096]
        d = squares[None] - 2 * part @ centres.T
        label[low : low + 4096] = d.argmin(axis=1)
        gap[low : low + 4096] = d.min(axis=1) + (part * part).sum(axis=1)
    return label, gap


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _units(rows: DataFrame, item: str, vector: str, name: str) -> DataFrame:
    unit = vectors.unit(F.col(vector).cast("array<double>"))
    return rows.select(F.col(item).cast("long").alias(name), unit.alias("unit")).filter(F.col("unit").isNotNull())


def build(items: DataFrame, path: str, item: str = "id", vector: str = "embedding", lists: int | None = None, subspaces: int = SUBSPACES, seed: int = 42) -> None:
    """Write the index of all rows of `items` to the shared folder `path`."""
    spark = items.sparkSession
    units = _units(items, item, vector, "item")
    sample = units.orderBy(F.xxhash64("item"), "item").limit(SAMPLE).toArrow()
    n = sample.num_rows
    if not n:
        raise ValueError("an index needs a vector")
    x = _matrix(sample.column("unit").combine_chunks())
    rng = np.random.default_rng(seed)
    k = min(n, MOST_LISTS, lists or max(1, round(units.count() ** 0.5)))
    centres = _k_means(x, k, rng)
    cuts = np.array_split(np.arange(x.shape[1]), min(subspaces, x.shape[1]))
    residual = x - centres[_closest(x, centres)[0]]
    books = [_k_means(residual[:, c], min(CODES, n), rng) for c in cuts]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("unit"))
            label, _ = _closest(v, centres)
            rest = v - centres[label]
            codes = np.stack([_closest(rest[:, c], b)[0] for c, b in zip(cuts, books, strict=True)], axis=1).astype(np.uint8)
            rows = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("unit"), rows, pa.array(label.astype(np.int32))], ["item", "unit", "codes", "list"])

    filed = units.mapInArrow(placed, "item long, unit array<double>, codes binary, list int")
    salt = F.pmod(F.xxhash64("item"), F.lit(8))  # a crowded list is several files
    filed.repartition("list", salt).write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    tables = {"centroids": [(i, c.tolist()) for i, c in enumerate(centres)], "books": [(i, b.ravel().tolist()) for i, b in enumerate(books)]}
    for name, rows in tables.items():
        spark.createDataFrame(rows, "place int, vector array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def _model(spark: SparkSession, path: str) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Centroids, code books and the columns of each subspace; at most `MOST_LISTS` and `CODES` rows."""
    found = {n: [r.vector for r in spark.read.parquet(f"{path}/{n}").orderBy("place").collect()] for n in ("centroids", "books")}
    centres = np.array(found["centroids"])
    cuts = np.array_split(np.arange(centres.shape[1]), len(found["books"]))
    return centres, [np.array(b).reshape(-1, len(c)) for b, c in zip(found["books"], cuts, strict=True)], cuts


def search(queries: DataFrame, path: str, k: int, query: str = "id", vector: str = "embedding", probes: int = PROBES, rerank: int | None = None) -> DataFrame:
    """query_id, item_id, similarity and rank of the `k` nearest rows of the index, by exact cosine among those that were looked at."""
    spark = queries.sparkSession
    centres, books, cuts = _model(spark, path)
    asked = _units(queries, query, vector, "query_id")
    wide, kept = min(probes, len(centres)), max(k, rerank or RERANK * k)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = np.argsort(-(_matrix(batch.column("unit")) @ centres.T), axis=1, kind="stable")[:, :wide]
            at = pa.array(np.repeat(np.arange(batch.num_rows), wide))
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id").take(at), batch.column("unit").take(at), pa.array(near.ravel().astype(np.int32))], ["query_id", "unit", "list"]
            )

    asks = materialize(asked.mapInArrow(routed, "query_id long, unit array<double>, list int"))
    stored = spark.read.parquet(f"{path}/lists")
    sizes = stored.groupBy("list").agg(F.count(F.lit(1)).alias("rows"))
    crowds = asks.groupBy("list").agg(F.count(F.lit(1)).alias("asks"))
    parts = sizes.join(crowds, "list").select(
        "list", F.ceil(F.col("rows") / PART_ROWS).alias("parts"), F.ceil(F.col("asks") / PART_QUERIES).alias("chunks")
    )
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    held = stored.join(parts, "list").select("list", place("item", "parts").alias("part"), every("chunks").alias("chunk"), "item", "codes")
    come = asks.join(parts, "list").select("list", every("parts").alias("part"), place("query_id", "chunks").alias("chunk"), "query_id", "unit")
    key = ["list", "part", "chunk"]

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        none = {"query_id": pa.array([], pa.int64()), "item": pa.array([], pa.int64()), "list": pa.array([], pa.int32()), "score": pa.array([], pa.float64())}
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_pydict(none)
        number = left.column("list")[0].as_py()
        items = left.column("item").to_numpy()
        order = np.argsort(items)
        items = items[order]
        codes = np.frombuffer(b"".join(left.column("codes").to_pylist()), np.uint8).reshape(len(items), -1)[order]
        q = _matrix(right.column("unit").combine_chunks())
        best = min(kept, len(items))
        ids, scores = [], []
        for low in range(0, len(q), 64):  # a block of scores takes 64 x PART_ROWS numbers
            part = q[low : low + 64]
            score = np.repeat((part @ centres[number])[:, None], len(items), axis=1)
            for j, (c, b) in enumerate(zip(cuts, books, strict=True)):
                score += (part[:, c] @ b.T)[:, codes[:, j]]
            top = np.argsort(-score, axis=1, kind="stable")[:, :best]
            ids.append(items[top].ravel())
            scores.append(np.take_along_axis(score, top, axis=1).ravel())
        asks_of = np.repeat(right.column("query_id").to_numpy(), best)
        return pa.Table.from_pydict(
            {"query_id": asks_of, "item": np.concatenate(ids), "list": np.full(len(asks_of), number, np.int32), "score": np.concatenate(scores)}
        )

    found = held.groupBy(*key).cogroup(come.groupBy(*key)).applyInArrow(scored, "query_id long, item long, list int, score double")
    few = scan.top_k(found, ["query_id"], [F.desc("score"), F.col("item")], kept).select("query_id", "item", "list")
    wanted = few.join(asked.withColumnRenamed("unit", "mine"), "query_id")
    met = wanted.join(stored.select("list", "item", "unit"), ["list", "item"])
    exact = met.select("query_id", F.col("item").alias("item_id"), vectors.dot("mine", "unit").alias("similarity"))
    return scan.top_k(exact, ["query_id"], [F.desc("similarity"), F.col("item_id")], k)
