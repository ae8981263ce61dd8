"""A small market: 300 trading days, eight firms, every edge the event study has to treat."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd

DAYS = [d.date() for d in pd.bdate_range("2020-01-01", periods=300)]
EVENT = 200


def build(seed: int = 1) -> dict[str, pd.DataFrame]:
    rng = np.random.default_rng(seed)
    factors = pd.DataFrame({"date": DAYS, "mktrf": rng.normal(0, 0.01, 300), "rf": 0.0001})
    for f in ("smb", "hml", "umd"):
        factors[f] = rng.normal(0, 0.005, 300)
    rows = []
    for permno in range(1, 9):
        beta = 0.5 + permno / 5
        for i, d in enumerate(DAYS):
            ret = beta * factors.mktrf[i] + 0.3 * factors.smb[i] + rng.normal(0, 0.01)
            est = range(EVENT - 160, EVENT - 60)
            if permno == 3 and i in list(est)[:30]:
                continue  # 70 estimation returns: just enough
            if permno == 4 and i in list(est)[:31]:
                ret = None  # 69: too few
            if permno == 5 and i == EVENT + 3:
                continue  # hole in the event window
            if permno == 6 and i == EVENT:
                continue  # no return on the event day
            rows.append((permno, d, -(10.0 + permno), ret, 100.0 * permno, 1.0, 1.0, 1.0))
    dsf = pd.DataFrame(rows, columns=["permno", "date", "prc", "ret", "shrout", "vol", "cfacpr", "cfacshr"])
    events = pd.DataFrame(
        [(p, DAYS[EVENT], round(-0.8 + 0.2 * p, 4)) for p in range(1, 8)]
        + [(1, DAYS[EVENT + 30], 0.4), (2, DAYS[EVENT] + timedelta(days=(5 - DAYS[EVENT].weekday())), 0.1), (8, DAYS[20], 0.3), (8, DAYS[296], 0.2)],
        columns=["permno", "edate", "sentiment"],
    )
    return {
        "dsf": dsf,
        "dsi": pd.DataFrame({"date": DAYS}),
        "factors_daily": factors,
        "dsedelist": pd.DataFrame({"permno": [7], "dlstdt": [DAYS[EVENT + 5]], "dlret": [-0.3]}),
        "events": events,
        **_fundamentals(rng),
    }


def _fundamentals(rng) -> dict[str, pd.DataFrame]:
    quarters = [date(2018, 3, 31) + timedelta(days=91 * i) for i in range(11)]
    fundq, funda, links, names, history, estimates = [], [], [], [], [], []
    for permno in range(1, 9):
        gvkey = f"g{permno}"
        for i, q in enumerate(quarters):
            value = rng.uniform(1, 9, 10).round(3)
            assets = 0.0 if permno == 8 else 100.0 + permno
            fundq.append(
                (gvkey, f"T{permno}", q, f"{2018 + i // 4}Q{i % 4 + 1}", q + timedelta(days=30), 2018 + i // 4, i % 4 + 1, 12, value[0], value[1],
                 assets, value[3], value[4], value[5], value[6], value[7], value[8], value[9], "STD", "C", "INDL")
            )
            if i % 4 == 3:
                funda.append((gvkey, q, 50.0 + i + permno, 5.0 + i, "STD", "C", "INDL"))
            for back in (40, 10):
                estimates.append((f"I{permno}", q, q - timedelta(days=back), 3, 1.0, 1.0 + back / 100, 1.5, "EPS", "QTR"))
        links += [(gvkey, permno, date(2015, 1, 1), None, "LU", "P"), (gvkey, permno, date(2015, 1, 1), None, "NR", "P")]
        names += [(permno, f"OLD{permno}", "old", date(2010, 1, 1), date(2018, 6, 30)), (permno, f"T{permno}", f"Firm {permno}", date(2018, 7, 1), None)]
        history.append((permno, f"I{permno}", date(2010, 1, 1), None))
    months = [d.date() for d in pd.date_range("2017-01-31", periods=50, freq="ME")]
    msf = [(p, f"c{p}", m, -(20.0 + p), float(rng.normal(0, 0.05)), 10.0 * p) for p in range(1, 9) for m in months]
    columns = (
        "gvkey tic datadate datacqtr rdq fyearq fqtr fyr epsfxq ibq atq dlttq lctq teqq capxy cheq ppentq xrdq datafmt consol indfmt"
    ).split()
    return {
        "fundq": pd.DataFrame(fundq, columns=columns),
        "funda": pd.DataFrame(funda, columns="gvkey datadate sale emp datafmt consol indfmt".split()),
        "ccmxpf_linktable": pd.DataFrame(links, columns="gvkey lpermno linkdt linkenddt linktype linkprim".split()),
        "stocknames": pd.DataFrame(names, columns="permno ticker comnam namedt nameendt".split()),
        "ibcrsphist": pd.DataFrame(history, columns="permno ticker sdate edate".split()),
        "statsum_epsus": pd.DataFrame(
            estimates, columns="ticker fpedats statpers numest meanest medest actual measure fiscalp".split()
        ),
        "msf": pd.DataFrame(msf, columns="permno cusip date prc ret shrout".split()),
    }


def frames(spark, tables: dict[str, pd.DataFrame]):
    from callweave import schemas

    out = {}
    for name, df in tables.items():
        rows = [tuple(None if v is None or v is pd.NaT or v != v else (v.item() if hasattr(v, "item") else v) for v in r) for r in df.astype(object).itertuples(index=False)]
        schema = "permno long, edate date, sentiment double" if name == "events" else schemas.MARKET[name]
        if name != "events":
            rows = [tuple(dict(zip(df.columns, r)).get(f.name) for f in schema.fields) for r in rows]
            rows = [tuple(float(v) if f.dataType.simpleString() == "double" and v is not None else v for v, f in zip(r, schema.fields)) for r in rows]
        out[name] = spark.createDataFrame(rows, schema)
    return out
