"""Ordered scans give the same answer in a plain window and over ranges."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from callweave.operators import scan


@pytest.fixture(scope="module")
def frame():
    """400 rows, a third of them under one key, values with gaps, one NULL key."""
    rng = np.random.default_rng(3)
    keys = ["hot"] * 140 + [f"k{i % 9}" for i in range(250)] + [None] * 10
    df = pd.DataFrame({"k": keys, "t": rng.permutation(400), "x": rng.normal(0, 0.1, 400).round(4)})
    df.loc[rng.choice(400, 120, replace=False), "x"] = np.nan
    return df


def as_spark(spark, df):
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in df.itertuples(index=False)]
    return spark.createDataFrame([(k, int(t), x) for k, t, x in rows], "k string, t long, x double")


@pytest.mark.parametrize("bounded", [True, False])
def test_running(spark, frame, bounded):
    got = scan.running(
        as_spark(spark, frame), ["k"], [F.col("t")], bounded,
        rn=scan.rows(), total=scan.total(F.col("x")), growth=scan.product(1 + F.col("x")), last=scan.latest(F.col("x")),
    ).toPandas()
    want = frame.sort_values("t")
    groups = want.groupby("k", dropna=False)
    want = want.assign(
        rn=groups.cumcount() + 1,
        total=groups["x"].transform(lambda s: s.fillna(0).cumsum().where(s.notna().cumsum() > 0)),
        growth=groups["x"].transform(lambda s: (1 + s.fillna(0)).cumprod().where(s.notna().cumsum() > 0)),
        last=groups["x"].ffill(),
    )
    both = got.merge(want, on="t", suffixes=("", "_w"))
    assert len(both) == len(got) == 400
    for c in ("rn", "total", "growth", "last"):
        np.testing.assert_allclose(both[c].astype(float), both[f"{c}_w"].astype(float), rtol=1e-12)


@pytest.mark.parametrize("bounded", [True, False])
def test_running_without_keys_and_descending(spark, frame, bounded):
    got = scan.running(as_spark(spark, frame), [], [F.desc("t")], bounded, rn=scan.rows()).toPandas()
    assert (got["rn"] == 400 - got["t"]).all()


@pytest.mark.parametrize(("bounded", "block_rows"), [(True, 1), (False, 15), (False, 10_000)])
def test_trailing_windows(spark, frame, bounded, block_rows):
    data = frame.dropna(subset=["k"])
    outs = {
        "total": lambda o, f: F.when(F.count("x").over(f) == 4, F.sum("x").over(f)),
        "filled": lambda o, f: F.last("x", ignorenulls=True).over(f),
        "before": lambda o, f: F.lag("x", 1).over(o),
    }
    got = scan.trailing(as_spark(spark, data), ["k"], [F.col("t")], 3, outs, bounded, block_rows).toPandas()
    want = data.sort_values("t")
    groups = want.groupby("k")["x"]
    want = want.assign(
        total=groups.transform(lambda s: s.rolling(4, min_periods=4).sum()),
        filled=groups.ffill(limit=3),
        before=groups.shift(1),
    )
    both = got.merge(want, on="t", suffixes=("", "_w"))
    assert len(both) == len(data)
    for c in ("total", "filled", "before"):
        np.testing.assert_allclose(both[c].astype(float), both[f"{c}_w"].astype(float), atol=1e-12)


@pytest.mark.parametrize("bounded", [True, False])
def test_quantiles(spark, frame, bounded):
    data = frame.dropna(subset=["k"])
    got = scan.quantiles(as_spark(spark, data), ["k"], "x", {"q33": 0.33, "q67": 0.67}, bounded).toPandas().set_index("k")
    want = data.groupby("k")["x"].quantile([0.33, 0.67]).unstack()
    np.testing.assert_allclose(got.loc[want.index, ["q33", "q67"]], want)


def test_quantile_without_keys(spark, frame):
    got = scan.quantiles(as_spark(spark, frame), [], "x", {"median": 0.5}).first()["median"]
    assert got == pytest.approx(frame["x"].median())


@pytest.mark.parametrize("bounded", [True, False])
def test_lists_continue_in_parts(spark, frame, bounded):
    data = as_spark(spark, frame.dropna(subset=["k"]))
    got = scan.ordered_lists(data, ["k"], [F.col("t")], F.col("t"), "ts", 25, bounded).toPandas()
    hot = got[got.k == "hot"].sort_values("part")
    assert list(hot.part) == [0, 1, 2, 3, 4, 5]
    assert [len(v) for v in hot.ts] == [25] * 5 + [15]
    assert [t for v in hot.ts for t in v] == sorted(frame[frame.k == "hot"].t)


def test_top_k_is_cut_before_the_shuffle(spark, frame):
    df = scan.top_k(as_spark(spark, frame), ["k"], [F.col("t")], 2)
    assert df.groupBy("k").count().filter("count <> 2").count() == 0
    assert df._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
