"""Latest open records and the inverted-file index against plain comparison."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest

from callweave.operators import stabbing, vector_index

DAY = dt.date(2020, 1, 1)


def _plain(lookups, records):
    out = {}
    for key, day in lookups:
        if key is not None and day is not None:
            open_ = [r for r in records if r[0] == key and r[2] is not None and r[2] <= day and (r[3] is None or r[3] >= day)]
            best = max(open_, key=lambda r: (r[2], r[1]), default=None)
            out[key, day] = (None, None) if best is None else (best[1], best[2])
    return out


def _found(spark, lookups, records):
    asked = spark.createDataFrame(lookups, "ticker string, date date")
    known = spark.createDataFrame(records, "ticker string, permno long, namedt date, nameendt date")
    got = stabbing.latest_open(asked, known, "ticker", "date", "namedt", "nameendt", "permno")
    assert got.columns == ["ticker", "date", "permno", "namedt"]
    rows = got.collect()
    assert len(rows) == len({(r.ticker, r.date) for r in rows})
    return {(r.ticker, r.date): (r.permno, r.namedt) for r in rows}


def _case(seed, keys, records, lookups, longest):
    rnd = random.Random(seed)
    day = lambda: rnd.choice([None] + [DAY + dt.timedelta(rnd.randrange(900))] * 30)
    known = []
    for _ in range(records):
        start = day()
        end = None if start is None or rnd.random() < 0.02 else start + dt.timedelta(rnd.randrange(-2, longest))
        known.append((rnd.choice(keys), rnd.randrange(50), start, end))
    return [(rnd.choice(keys), day()) for _ in range(lookups)], known


@pytest.mark.parametrize("longest", [20, 900])
def test_latest_open_matches_comparison(spark, longest):
    lookups, records = _case(longest, ["a", "b", "c", None], 120, 300, longest)
    assert _found(spark, lookups, records) == _plain(lookups, records)


@pytest.mark.parametrize("longest", [12, 400, 3000])
def test_a_hot_key_spans_ranges(spark, longest):
    """One key over twelve ranges: answers come from skylines of earlier ranges."""
    lookups, records = _case(longest, ["hot"] * 9 + ["cold"], 400, 900, longest)
    kept = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for name, value in zip(kept, (12, "false")):
        spark.conf.set(name, value)
    try:
        assert _found(spark, lookups, records) == _plain(lookups, records)
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)


def test_rows_stay_linear(spark):
    """A hundred records open on every day of a ticker's lookups give one row a lookup."""
    records = [("t", i, DAY, DAY + dt.timedelta(2000 + i)) for i in range(100)]
    lookups = [("t", DAY + dt.timedelta(i)) for i in range(500)]
    assert _found(spark, lookups, records) == {(t, d): (99, DAY) for t, d in lookups}
    assert _found(spark, [], records) == {} and _found(spark, lookups[:2], []) == {x: (None, None) for x in lookups[:2]}


def _vectors(n, dims, seed=0):
    """Unit-scale vectors around forty directions."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(40, dims))[rng.integers(0, 40, n)] + 0.6 * rng.normal(size=(n, dims))


def _rows(spark, x, name="id"):
    return spark.createDataFrame([(i, None if v is None else [float(c) for c in v]) for i, v in enumerate(x)], f"{name} long, embedding array<double>")


def _nearest(x, q, k):
    u, v = x / np.linalg.norm(x, axis=1, keepdims=True), q / np.linalg.norm(q, axis=1, keepdims=True)
    return np.argsort(-(v @ u.T), axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize("part", [50_000, 30])
def test_index_recall(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(vector_index, "PART_ROWS", part)
    monkeypatch.setattr(vector_index, "PART_QUERIES", part)
    x, q = _vectors(2_000, 24), _vectors(60, 24, 1)
    vector_index.build(_rows(spark, x), f"{tmp_path}/index", lists=32)
    got = vector_index.search(_rows(spark, q), f"{tmp_path}/index", 10).toPandas()
    assert (got.groupby("query_id").size() == 10).all() and got["query_id"].nunique() == 60
    true = _nearest(x, q, 10)
    pairs = set(zip(got["query_id"].tolist(), got["item_id"].tolist()))
    recall = np.mean([(i, j) in pairs for i in range(60) for j in true[i].tolist()])
    print("recall", recall)
    assert recall >= 0.95
    first = got[got["rank"] == 1].set_index("query_id")
    u = x[first["item_id"]] / np.linalg.norm(x[first["item_id"]], axis=1, keepdims=True)
    v = q[first.index] / np.linalg.norm(q[first.index], axis=1, keepdims=True)
    assert np.allclose(first["similarity"], (u * v).sum(axis=1))


def test_index_with_all_probes_is_exact(spark, tmp_path):
    x, q = _vectors(150, 6), _vectors(9, 6, 2)
    x = [*x, None, np.zeros(6), x[3]]
    vector_index.build(_rows(spark, x), f"{tmp_path}/index", lists=8, subspaces=3)
    assert spark.read.parquet(f"{tmp_path}/index/lists").count() == 151
    got = vector_index.search(_rows(spark, q), f"{tmp_path}/index", 4, probes=8, rerank=200).toPandas().sort_values(["query_id", "rank"])
    known = np.array([v for v in x[:150]] + [x[3]])
    want = _nearest(known, q, 4)
    assert got["item_id"].tolist() == [152 if i == 150 else i for i in want.ravel().tolist()]
    with pytest.raises(ValueError, match="vector"):
        vector_index.build(_rows(spark, x).filter("id < 0"), f"{tmp_path}/none")
