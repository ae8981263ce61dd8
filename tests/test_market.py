"""Event study, covariates, regression and portfolios against plain numpy and pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from market_fixture import DAYS, EVENT, build, frames
from pyspark.sql import functions as F

from callweave.functions.student import two_sided_p
from callweave.plans import covariates, eventstudy, portfolio, regression, sentiment

FACTORS = {"madj": [], "m": ["mktrf"], "ff": ["smb", "hml", "mktrf"], "ffm": ["smb", "hml", "mktrf", "umd"]}


@pytest.fixture(scope="module")
def market():
    return build()


@pytest.fixture(scope="module")
def tables(spark, market):
    return frames(spark, market)


def study(tables, model, **options):
    return eventstudy.event_study(
        tables["events"], tables["dsf"], tables["dsi"], tables["factors_daily"], tables["dsedelist"], model=model, **options
    )


def expected(market, model):
    """The definition, event by event."""
    rows = market["dsf"].merge(market["factors_daily"], on="date").merge(
        market["dsedelist"].rename(columns={"dlstdt": "date"}), on=["permno", "date"], how="left"
    )
    rows["ret"] = (1 + rows.ret.astype(float)) * (1 + rows.dlret.fillna(0)) - 1
    rows["td"] = rows.date.map({d: i for i, d in enumerate(DAYS)})
    rows["mkt"] = rows.mktrf + rows.rf
    out = []
    for permno, edate, _ in market["events"].itertuples(index=False):
        if edate not in DAYS:
            continue
        at = DAYS.index(edate)
        if at - 160 < 0 or at + 10 >= len(DAYS):
            continue
        own = rows[(rows.permno == permno) & rows.ret.notna()].assign(rel=lambda d: d.td - at).sort_values("td")
        est, evt = own[own.rel.between(-160, -61)], own[own.rel.between(-10, 10)].copy()
        if len(est) < 70 or 0 not in set(evt.rel) or len(evt) != 21:
            continue
        if model == "madj":
            ex = est.ret - est.mkt
            var, evt["expret"] = ex.var(ddof=1), evt.mkt
        else:
            names = FACTORS[model]
            x = np.column_stack([np.ones(len(est)), est[names]])
            b, res, *_ = np.linalg.lstsq(x, est.ret, rcond=None)
            var = res[0] / (len(est) - x.shape[1])
            evt["expret"] = np.column_stack([np.ones(21), evt[names]]) @ b
        evt["abret"] = evt.ret - evt.expret
        evt["car"] = evt.abret.cumsum()
        evt["cret"] = (1 + evt.ret).cumprod() - 1
        evt["bhar"] = evt.cret - ((1 + evt.expret).cumprod() - 1)
        evt["sar"] = evt.abret / np.sqrt(var)
        evt["scar"] = evt.car / np.sqrt(21 * var)
        evt["pat_scale"] = (len(est) - 2) / (len(est) - 4)
        evt["edate"] = edate
        out.append(evt)
    return pd.concat(out)


@pytest.mark.parametrize("model", list(FACTORS))
def test_models(tables, market, model):
    got = study(tables, model).windows.toPandas()
    want = expected(market, model)
    both = got.merge(want, left_on=["permno", "edate", "evttime"], right_on=["permno", "edate", "rel"], suffixes=("", "_w"))
    assert len(both) == len(got) == len(want) == 5 * 21
    for c in ("ret", "expret", "abret", "car", "cret", "bhar", "sar", "scar", "pat_scale"):
        np.testing.assert_allclose(both[c], both[f"{c}_w"], rtol=1e-8, atol=1e-12)
    last = got[got.evttime == 10].set_index(["permno", "edate"])
    joined = got.set_index(["permno", "edate"])
    np.testing.assert_allclose(joined.car_edate, last.car.reindex(joined.index))


def test_rejected_events_have_reasons(tables):
    reasons = {(r.permno, r.reason) for r in study(tables, "madj").rejected.collect()}
    assert (4, "too few estimation returns") in reasons
    assert (5, "incomplete event window") in reasons
    assert (6, "no return on the event day") in reasons
    assert (2, "not a trading day with room for the windows") in reasons
    assert sum(p == 8 for p, _ in reasons) == 1
    assert study(tables, "madj").rejected.count() == 6


def test_cross_section(tables):
    s = study(tables, "m")
    stats, w = s.stats.toPandas().set_index("evttime"), s.windows.toPandas()
    g = w.groupby("evttime")
    np.testing.assert_allclose(stats.abret_t.loc[0], g.abret.mean()[0] / (g.abret.std()[0] / np.sqrt(5)))
    np.testing.assert_allclose(stats.pat_ar.loc[3], g.sar.mean()[3] / (np.sqrt(g.pat_scale.sum()[3]) / 5))
    assert (stats.pat_car_edate_mean == 0).all() and list(stats.index.sort_values()) == list(range(-10, 11))
    assert s.event_date.count() == 5 and s.event_window.columns == ["permno", "edate", "rdate", "evttime", "ret", "abret"]


def test_unknown_model(tables):
    with pytest.raises(ValueError):
        study(tables, "capm")


def test_event_window_reuses_the_fit_partitioning(tables):
    plan = study(tables, "madj").windows._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("ObjectHashAggregate")]
    assert "Exchange" not in top and top.count("Sort [") == 1


def _pulled(tables):
    names = ["fundq", "funda", "ccmxpf_linktable", "stocknames", "ibcrsphist", "statsum_epsus", "msf"]
    return covariates.fundamentals(tables["events"], *[tables[n] for n in names])


def test_fundamentals(tables, market):
    got = _pulled(tables).toPandas()
    assert len(got) == 8 * 11
    assert set(got[got.datadate < pd.Timestamp("2018-07-01").date()].ticker) == {f"OLD{i}" for i in range(1, 9)}
    assert (got.medest.dropna() == 1.1).all() and got.medest.notna().all()
    m = market["msf"].sort_values(["permno", "date"])
    m["vol"] = m.groupby("permno").ret.transform(lambda s: np.sqrt((s**2).rolling(12, min_periods=12).sum()))
    m["growth"] = m.groupby("permno").ret.transform(lambda s: (1 + s).rolling(3, min_periods=3).apply(np.prod, raw=True)) - 1
    want = pd.merge_asof(
        got[["permno", "datadate"]].assign(d=pd.to_datetime(got.datadate)).sort_values("d"),
        m.assign(d=pd.to_datetime(m.date)).sort_values("d")[["permno", "d", "vol", "growth", "date"]],
        on="d", by="permno", tolerance=pd.Timedelta("31D"),
    )
    both = got.merge(want, on=["permno", "datadate"])
    np.testing.assert_allclose(both.Stock_Volatility.astype(float), both.vol, rtol=1e-9)
    np.testing.assert_allclose(both.Stock_Return.astype(float), both.growth, rtol=1e-9)
    assert (both.date_x == both.date_y).all()


def test_covariates_carry_and_lag(tables):
    got = covariates.covariates(_pulled(tables)).toPandas().sort_values(["permno", "ticker", "datadate"])
    got["carried"] = got.groupby(["permno", "ticker"]).sale.ffill(limit=3)
    assert (got.sale.fillna(-1) == got.carried.fillna(-1)).all()
    lagged = got.sort_values("fyearq").groupby(["permno", "ticker", "fqtr"]).sale.shift(1)
    assert (got.sale_lagged.astype(float).fillna(-1) == lagged.reindex(got.index).astype(float).fillna(-1)).all()
    assert got[got.permno == 8].Return_on_Assets.isna().all()
    assert np.allclose((got.cap + got.total_debt_q - got.cash_and_short_term_investments_q)[got.permno == 1] / 101.0, got.Market_to_Book[got.permno == 1].astype(float))


def test_event_covariates_are_strictly_before_the_event(tables):
    rows = covariates.event_covariates(study(tables, "madj"), covariates.covariates(_pulled(tables)), tables["events"]).toPandas()
    assert len(rows) and (rows.datadate < rows.edate).all() and rows.notna().all().all()


def test_regression_matches_least_squares(spark):
    rng = np.random.default_rng(0)
    data, wanted = [], {}
    for theme in ("a", "b"):
        x = rng.normal(5, [1, 100, 0.01], (40, 3))
        y = x @ [1.0, 0.01, 3.0] + rng.normal(0, 0.5, 40)
        full = np.column_stack([np.ones(40), x])
        b = np.linalg.lstsq(full, y, rcond=None)[0]
        res = y - full @ b
        mse = res @ res / 36
        wanted[theme] = (b, np.sqrt(np.diag(np.linalg.inv(full.T @ full)) * mse), 1 - res @ res / ((y - y.mean()) @ (y - y.mean())))
        data += [(theme, *map(float, r), float(v)) for r, v in zip(x, y)]
    df = spark.createDataFrame(data, "theme_id string, x1 double, x2 double, x3 double, y double")
    for r in regression.fit_groups(df, ["theme_id"], "y", ["x1", "x2", "x3"]).collect():
        b, se, rsq = wanted[r.theme_id]
        np.testing.assert_allclose(r.coef, b, rtol=1e-7)
        np.testing.assert_allclose(r.se, se, rtol=1e-7)
        np.testing.assert_allclose(r.t, b / se, rtol=1e-7)
        assert r.rsq == pytest.approx(rsq) and r.n_obs == 40 and r.rank == 3
        assert r.adj_rsq == pytest.approx(1 - 39 / 36 * (1 - rsq))


def test_rank_deficient_regression_is_minimum_norm(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(1, 1, 12)
    y = 2 * x + rng.normal(0, 0.1, 12)
    full = np.column_stack([np.ones(12), x, 2 * x, np.full(12, 3.0)])
    df = spark.createDataFrame([("a", float(a), float(2 * a), 3.0, float(b)) for a, b in zip(x, y)], "g string, x1 double, x2 double, x3 double, y double")
    r = regression.fit_groups(df, ["g"], "y", ["x1", "x2", "x3"]).first()
    np.testing.assert_allclose(r.coef, np.linalg.pinv(full) @ y, rtol=1e-6)
    assert r["rank"] == 1


def test_p_values():
    t, dof = np.array([2.2281, 12.7062, 2.8453, 1.9840]), np.array([10, 1, 20, 100])
    np.testing.assert_allclose(two_sided_p(t, dof), [0.05, 0.05, 0.01, 0.05], atol=2e-5)
    assert two_sided_p(np.array([0.0]), 5)[0] == pytest.approx(1.0)
    assert np.isnan(two_sided_p(np.array([np.nan]), 5)[0]) and np.isnan(two_sided_p(np.array([1.0]), 0)[0])


def test_summary_ranks_and_formats(spark):
    rows = [("t1", "Name", [0.0, 0.5], [1.0, 0.1], [0.0, 5.0], [1.0, 0.0004], 0.5, 0.4, 30), ("t2", "N" * 60, [0.0, -0.2], [1.0, 0.1], [0.0, 2.0], [1.0, 0.04], 0.3, 0.2, 20)]
    schema = "theme_id string, theme_name string, coef array<double>, se array<double>, t array<double>, p array<double>, rsq double, adj_rsq double, n_obs long"
    summary = regression.significance_summary(spark.createDataFrame(rows, schema))
    got = {r.Theme_ID: r for r in summary.collect()}
    assert (got["t1"]["rank"], got["t1"].Significance, got["t2"]["rank"], got["t2"].Significance) == (1, "***", 2, "*")
    totals = regression.summary_stats(summary).first()
    assert (totals.n_below_05, totals.n_below_001, totals.n_positive, totals.n_negative) == (2, 1, 1, 1)
    assert totals.mean_abs_coef == pytest.approx(0.35)
    report = regression.summary_report(summary).orderBy("section", "rank", "part").collect()
    lines = [r.line for r in report if r.section == 1]
    assert "N" * 47 + "..." in lines[1] and "+0.500000" in lines[0]
    text = "\n".join(r.line for r in report)
    assert "Themes: 2" in text and "p < 0.001: 1 (50.0%)" in text and text.index("  1. Name") < text.index("  2. NNN")
    assert regression.summary_report(summary.limit(0)).filter("section IN (1, 3)").count() == 0


def _portfolio_by_hand(events, dsf, weighting):
    out = []
    for theme, evs in events.groupby("theme_id"):
        end = max(evs.edate) + pd.Timedelta(days=120).to_pytimedelta()
        held = []
        for _, e in evs.iterrows():
            own = dsf[(dsf.permno == e.permno) & (dsf.date >= e.edate) & (dsf.date <= end)].sort_values("date")
            held.append(own.assign(sentiment=e.sentiment, day=range(len(own))))
        rows = pd.concat(held)
        rows["cap"] = rows.prc.abs() * rows.shrout
        q = rows.groupby("day").sentiment.quantile([0.33, 0.67]).unstack()
        lo, hi = rows.day.map(q[0.33]), rows.day.map(q[0.67])
        rows["bucket"] = np.where(rows.sentiment <= lo, "Low", np.where(rows.sentiment <= hi, "Medium", "High"))
        for bucket, part in rows[rows.day <= 90].groupby("bucket"):
            series = {0: 0.0}
            for day, cell in part.groupby("day"):
                if weighting == "equal":
                    series[day] = cell.ret.astype(float).mean()
                else:
                    total = cell.cap.sum()
                    series[day] = (cell.ret.astype(float).values * (cell.cap.values / total)).sum() if total > 0 else 0.0
            grown = 1.0
            for day in sorted(series):
                grown = grown * (1 + series[day]) if day else 1.0
                out.append((theme, bucket, day, series[day], grown - 1))
    return pd.DataFrame(out, columns=["theme_id", "bucket", "days_from_event", "vw", "cum"])


@pytest.mark.parametrize("weighting", ["value", "equal"])
def test_portfolios(spark, tables, market, weighting):
    events = market["events"]
    events = pd.concat([events.assign(theme_id="a"), events[events.permno.isin([1, 4, 7])].assign(theme_id="b")])
    ev = spark.createDataFrame([(int(p), d, float(s), t) for p, d, s, t in events.values], "permno long, edate date, sentiment double, theme_id string")
    got = portfolio.portfolio_returns(ev.withColumn("theme_name", F.lit("n")), tables["dsf"], weighting).toPandas()
    want = _portfolio_by_hand(events, market["dsf"], weighting)
    both = got.merge(want, on=["theme_id", "bucket", "days_from_event"])
    assert len(both) == len(got) == len(want)
    np.testing.assert_allclose(both.vw_return.astype(float), both.vw.astype(float), atol=1e-12)
    np.testing.assert_allclose(both.cumulative_return.astype(float), both.cum.astype(float), atol=1e-10)
    assert (got[got.days_from_event == 0].cumulative_return == 0).all()


def test_missing_return_breaks_a_value_weighted_series(spark):
    rows = [(1, DAYS[i], 10.0, None if i == 2 else 0.01, 5.0) for i in range(5)]
    dsf = spark.createDataFrame(rows, "permno long, date date, prc double, ret double, shrout double")
    ev = spark.createDataFrame([("a", "n", 1, DAYS[0], None)], "theme_id string, theme_name string, permno long, edate date, sentiment double")
    got = {r.days_from_event: r for r in portfolio.portfolio_returns(ev, dsf).collect()}
    assert got[1].bucket == "High" and got[1].cumulative_return == pytest.approx(0.01)
    assert got[2].vw_return is None and got[3].cumulative_return is None
    equal = {r.days_from_event: r for r in portfolio.portfolio_returns(ev, dsf, "equal").collect()}
    assert equal[2].vw_return is None and equal[1].vw_return == pytest.approx(0.01)
    with pytest.raises(ValueError):
        portfolio.portfolio_returns(ev, dsf, "rank")


def test_theme_results_keep_every_theme(tables):
    ev = tables["events"].withColumns({"theme_id": F.lit("a"), "theme_name": F.lit("n")})
    more = ev.unionByName(ev.filter("permno = 1").withColumns({"theme_id": F.lit("b"), "sentiment": F.lit(0.9)}))
    once = sentiment.study_events(more)
    assert once.count() == tables["events"].count()
    rows = sentiment.theme_results(study(tables, "madj").event_date, more)
    assert rows.filter("theme_id = 'b' AND sentiment = 0.9").count() == 2
