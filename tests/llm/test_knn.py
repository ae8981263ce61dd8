from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.llm import voronoi_knn

SCHEMA = "vec_id long, embedding array<float>, label int, row string, cell string, v string"


def rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (6, 8))
    out = [(i, [float(x) for x in centres[i % 6] * (1 + i % 3) + rng.normal(0, 0.1, 8)]) for i in range(300)]
    out += [(400 + i, [0.5] * 8) for i in range(150)]  # a common vector
    out += [(550, None), (600, [1.0, None] + [0.0] * 6), (650, [float("nan")] * 8), (700, [float("inf")] * 8)]
    out += [(750, []), (800, [1.0, 2.0]), (850, [0.0] * 8), (850, [0.0] * 8), (None, [1.0] * 8), (50, out[50][1])]
    return out


def brute(data, k):
    sound = [(i, v) for i, v in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    block = np.zeros((len(sound), 8), dtype=np.int64)
    for at, (_, v) in enumerate(sound):
        block[at, : len(v)] = np.floor(256 * np.array(v, dtype=np.float32).astype(float))
    out = []
    for at, (i, _) in enumerate(sound):
        if i % 50 == 0:
            scored = sorted((-int(block[at] @ block[j]), sound[j][0]) for j in range(len(sound)) if j != at)[:k]
            out += [(i, r + 1, c, -s) for r, (s, c) in enumerate(scored)]
    return sorted(out)


def frame(spark, data):
    return spark.createDataFrame([(i, v, 0, "r", "c", "v") for i, v in data], SCHEMA)


@pytest.mark.parametrize(("pivots", "group_queries", "block_rows"), [(64, 2048, 8192), (7, 2, 40), (1, 1, 1000)])
def test_matches_brute_force(spark, pivots, group_queries, block_rows):
    data = rows()
    got = voronoi_knn.top_k(
        frame(spark, data), F.col("vec_id") % 50 == 0, 5, pivots=pivots, group_queries=group_queries, block_rows=block_rows
    )
    assert sorted(tuple(r) for r in got.collect()) == brute(data, 5)


def test_bounds_leave_far_candidates_out(spark):
    rng = np.random.default_rng(0)
    data = [(i, [float(x) for x in np.eye(8)[i % 8] * 4 + rng.normal(0, 0.01, 8)]) for i in range(400)]
    points = voronoi_knn.materialize(voronoi_knn.quantised(frame(spark, data), "vec_id", "embedding", 256.0))
    where = voronoi_knn.space(points, 16)
    placed = voronoi_knn.placed(points, where, F.col("vec_id") % 50 == 0)
    reached, queries = voronoi_knn.bounds(placed, where, 5, 2, 1000)
    near = spark.createDataFrame(reached)
    kept = placed.join(near, "cell").filter(F.col("far").between(F.col("low"), F.col("high"))).count()
    assert kept < 0.6 * 400 * queries["group"].nunique()
    assert sorted(tuple(r) for r in voronoi_knn.top_k(frame(spark, data), F.col("vec_id") % 50 == 0, 5, pivots=16, group_queries=2).collect()) == brute(data, 5)


def test_large_components_stay_exact(spark):
    data = [(i, [1e7 + i, -2e7, 3.0 * i]) for i in range(60)]
    got = voronoi_knn.top_k(frame(spark, data), F.col("vec_id") % 50 == 0, 3)
    block = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(np.int64) for i, v in data}
    for q in (0, 50):
        want = sorted((-int(block[q] @ block[c]), c) for c in block if c != q)[:3]
        assert [(-r.score, r.vec_id) for r in got.filter(F.col("query_id") == q).orderBy("rank").collect()] == want


@pytest.mark.parametrize("data", [[], [(1, [1.0])], [(50, [1.0])], [(50, None)]])
def test_few_rows(spark, data):
    got = voronoi_knn.top_k(frame(spark, data), F.col("vec_id") % 50 == 0, 5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert got.collect() == []
