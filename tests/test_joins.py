"""As-of and interval joins against pandas and brute force."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from callweave.operators.asof import asof_join
from callweave.operators.intervals import interval_join

START = date(2020, 1, 1)


def _sides(seed=5):
    rng = np.random.default_rng(seed)
    left = pd.DataFrame({"k": rng.integers(0, 6, 200), "d": rng.integers(0, 120, 200), "id": range(200)})
    left.loc[:70, "k"] = 0
    right = pd.DataFrame({"k": rng.integers(0, 6, 150), "d": rng.integers(0, 120, 150), "v": range(150)})
    right.loc[:50, "k"] = 0
    return left, right


def _day(n):
    return START + timedelta(days=int(n))


@pytest.mark.parametrize("bounded", [True, False])
@pytest.mark.parametrize("options", [{}, {"strict": True}, {"within_days": 3}, {"direction": "forward"}, {"direction": "forward", "strict": True}])
def test_asof_matches_pandas(spark, bounded, options):
    left, right = _sides()
    ls = spark.createDataFrame([(int(k), _day(d), int(i)) for k, d, i in left.values], "k long, d date, id long")
    rs = spark.createDataFrame([(int(k), _day(d), int(v)) for k, d, v in right.values], "k long, rd date, v long")
    got = asof_join(ls, rs, ["k"], "d", "rd", {"v": "v", "rd": "at"}, tie=["v"], bounded=bounded, **options).toPandas()
    tolerance = options.get("within_days")
    # pandas keeps the last of equal right keys when looking back, the first when looking ahead
    ahead = options.get("direction") == "forward"
    best = right.sort_values("v").drop_duplicates(["k", "d"], keep="last").sort_values("d")
    want = pd.merge_asof(
        left.sort_values("d"), best, on="d", by="k", direction="forward" if ahead else "backward",
        allow_exact_matches=not options.get("strict", False), tolerance=tolerance,
    )
    both = got.merge(want, on="id", suffixes=("", "_w"))
    assert len(both) == len(got) == 200
    assert both["v"].fillna(-1).astype(int).tolist() == both["v_w"].fillna(-1).astype(int).tolist()


def test_null_keys_never_match(spark):
    left = spark.createDataFrame([(None, START), (1, None), (1, START)], "k long, d date")
    right = spark.createDataFrame([(None, START, 1), (1, START, 2)], "k long, rd date, v long")
    for bounded in (True, False):
        got = asof_join(left, right, ["k"], "d", "rd", {"v": "v"}, bounded=bounded).collect()
        assert sorted((r.k is None, r.d is None, r.v) for r in got) == [(False, False, 2), (False, True, None), (True, False, None)]


def test_unknown_direction(spark):
    df = spark.createDataFrame([(1, START)], "k long, d date")
    with pytest.raises(ValueError):
        asof_join(df, df.withColumnRenamed("d", "e"), ["k"], "d", "e", {}, direction="sideways")


@pytest.mark.parametrize("width", [7, 365, 5000])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_intervals_match_brute_force(spark, width, how):
    rng = np.random.default_rng(9)
    points = [(int(k), _day(d), i) for i, (k, d) in enumerate(zip(rng.integers(0, 4, 120), rng.integers(-40, 900, 120)))]
    points.append((1, date(2150, 5, 5), 120))
    spans = []
    for i in range(60):
        low = int(rng.integers(0, 800))
        high = None if i % 5 == 0 else _day(low + int(rng.integers(-3, 300)))
        spans.append((int(rng.integers(0, 4)), _day(low), high, i))
    spans.append((2, date(1850, 1, 1), date(2200, 1, 1), 60))
    ps = spark.createDataFrame(points, "k long, at date, p long")
    ss = spark.createDataFrame(spans, "k long, lo date, hi date, s long")
    got = {(r.p, r.s) for r in interval_join(ps, ss, ["k"], "at", "lo", "hi", how=how, width=width).collect()}
    want = {(p, s) for k, at, p in points for sk, lo, hi, s in spans if k == sk and lo <= at and (hi is None or at <= hi)}
    if how == "left":
        want |= {(p, None) for _, _, p in points if p not in {w[0] for w in want}}
    assert got == want
