"""Event study: abnormal returns around event dates under four risk models.

All events run in one plan. Returns meet events in a cell join on (permno, trading-day cell),
one aggregate per event yields the fit and the bounded list of its event-window rows, and
the running sums reuse that aggregate's partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions import dates, leastsq
from callweave.functions.fixed import MODEL_FACTORS, STUDY_WINDOW
from callweave.operators.intervals import interval_join

EVENT = ["permno", "edate"]
ALL_FACTORS = ["smb", "hml", "mktrf", "umd"]


@dataclass(frozen=True)
class Offsets:
    """Trading-day offsets of the windows around the event day."""

    est_start: int
    est_end: int
    evt_start: int
    evt_end: int

    @classmethod
    def of(cls, estwin: int, gap: int, evtwins: int, evtwine: int) -> Offsets:
        before = abs(evtwins)
        return cls(estwin + gap + before, gap + before + 1, before, evtwine)

    @property
    def length(self) -> int:
        return self.evt_start + self.evt_end + 1


@dataclass(frozen=True)
class Study:
    windows: DataFrame
    rejected: DataFrame
    model: str
    offsets: Offsets

    @property
    def event_window(self) -> DataFrame:
        return self.windows.select("permno", "edate", "rdate", "evttime", "ret", "abret")

    @property
    def event_date(self) -> DataFrame:
        last_day = F.col("evttime") == self.offsets.evt_end
        return self.windows.filter(last_day).select("permno", "edate", "cret", "car", "bhar")

    @property
    def stats(self) -> DataFrame:
        return cross_section(self.windows)


def trading_days(calendar: DataFrame, offsets: Offsets) -> DataFrame:
    """Trading-day number and the window dates of every day as event day.

    The window is global but holds one row per trading day, about 250 a year.
    """
    by_day = Window.orderBy("date")
    return calendar.select("date").distinct().select(
        "date",
        F.row_number().over(by_day).alias("td"),
        F.lag("date", offsets.est_start).over(by_day).alias("estwin1"),
        F.lag("date", offsets.est_end).over(by_day).alias("estwin2"),
        F.lag("date", offsets.evt_start).over(by_day).alias("evtwin1"),
        F.lead("date", offsets.evt_end).over(by_day).alias("evtwin2"),
    )


def daily_returns(returns: DataFrame, factors: DataFrame, delistings: DataFrame | None, days: DataFrame) -> DataFrame:
    """Returns with factors and delisting returns folded in; rows without return or market drop out."""
    present = [f for f in ALL_FACTORS if f in factors.columns]
    market = factors.filter(F.col("mktrf").isNotNull()).select("date", "rf", *present)
    rows = (
        returns.filter(F.col("ret").isNotNull())
        .select("permno", "date", F.col("ret").alias("ret1"))
        .join(days.select("date", "td").join(market, "date"), "date")
    )
    dlret: Column = F.lit(0.0)
    if delistings is not None:
        ended = delistings.select("permno", F.col("dlstdt").alias("date"), "dlret")
        rows = rows.join(ended, ["permno", "date"], "left")
        dlret = F.coalesce("dlret", F.lit(0.0))
    ret = (1 + F.col("ret1")) * (1 + dlret) - 1
    mkt = F.col("mktrf") + F.col("rf")
    return rows.select(
        "permno", F.col("date").alias("rdate"), "td", ret.alias("ret"), mkt.alias("mkt"),
        (ret - mkt).alias("exret"), *present,
    )


def _fit_columns(model: str, isest: Column) -> list[Column]:
    def at(c: str) -> Column:
        return F.when(isest, F.col(c))

    n = F.count(at("ret")).alias("nobs")
    if model == "madj":
        return [n, F.avg(at("exret")).alias("alpha"), F.var_samp(at("exret")).alias("var_estp")]
    if model == "m":
        y, x = at("ret"), at("mktrf")
        slope, sxy, syy = F.regr_slope(y, x), F.regr_sxy(y, x), F.regr_syy(y, x)
        return [
            n,
            F.regr_intercept(y, x).alias("alpha"),
            slope.alias("beta"),
            F.try_divide(syy - slope * sxy, F.regr_count(y, x) - 2).alias("var_estp"),
            F.regr_r2(y, x).alias("rsq"),
        ]
    return [n, *leastsq.moments(F.col("ret"), [F.col(f) for f in MODEL_FACTORS[model]], isest)]


def event_study(
    events: DataFrame,
    returns: DataFrame,
    calendar: DataFrame,
    factors: DataFrame,
    delistings: DataFrame | None = None,
    model: str = "madj",
    estwin: int = STUDY_WINDOW["estwin"],
    gap: int = STUDY_WINDOW["gap"],
    evtwins: int = STUDY_WINDOW["evtwins"],
    evtwine: int = STUDY_WINDOW["evtwine"],
    minval: int = STUDY_WINDOW["minval"],
) -> Study:
    """Abnormal returns of every distinct (permno, edate) in `events`.

    Events need `minval` estimation returns, a return on the event day and a full event
    window; the others are listed in `rejected`. Events off the calendar or without room
    for the windows are rejected too.
    """
    if model not in MODEL_FACTORS:
        raise ValueError(f"unknown model: {model}")
    off = Offsets.of(estwin, gap, evtwins, evtwine)
    days = trading_days(calendar, off)
    wanted = events.select(*EVENT).distinct()
    dated = wanted.join(days.withColumnRenamed("date", "edate"), "edate").filter(
        F.col("estwin1").isNotNull() & F.col("evtwin2").isNotNull()
    )
    spans = dated.select(
        *EVENT,
        F.col("td").alias("etd"),
        (F.col("td") - off.est_start).alias("first_td"),
        (F.col("td") + off.evt_end).alias("last_td"),
    )
    # only the events' firms and the dates their windows touch
    firms = dated.groupBy("permno").agg(F.min("estwin1").alias("_from"), F.max("evtwin2").alias("_to"))
    needed = returns.join(firms, "permno").filter(F.col("date").between(F.col("_from"), F.col("_to"))).select(*returns.columns)
    rows = daily_returns(needed, factors, delistings, days)
    met = interval_join(rows, spans, ["permno"], "td", "first_td", "last_td", width=256, floor=0, ceiling=2**31)
    rel = F.col("td") - F.col("etd")
    isest = rel.between(-off.est_start, -off.est_end)
    isevt = rel.between(-off.evt_start, off.evt_end)
    factor_names = [f for f in ALL_FACTORS if f in rows.columns]
    row = F.struct(rel.alias("evttime"), "rdate", "ret", "mkt", "exret", *factor_names)
    # at most one row per trading day of the event window, so the list is bounded
    grouped = (
        met.filter(isest | isevt)
        .groupBy(*EVENT)
        .agg(
            *_fit_columns(model, isest),
            F.count_if(isevt).alias("wins"),
            F.count_if(rel == 0).alias("flags"),
            F.collect_list(F.when(isevt, row)).alias("rows"),
        )
    )
    valid = (F.col("nobs") >= minval) & (F.col("flags") > 0) & (F.col("wins") == off.length)
    windows = _accumulate(_expected(grouped.filter(valid), model), off)

    reason = (
        F.when(F.col("etd").isNull(), "not a trading day with room for the windows")
        .when(F.coalesce("nobs", F.lit(0)) < minval, "too few estimation returns")
        .when(F.coalesce("flags", F.lit(0)) == 0, "no return on the event day")
        .when(F.coalesce("wins", F.lit(0)) != off.length, "incomplete event window")
    )
    counts = grouped.select(*EVENT, "nobs", "flags", "wins")
    rejected = (
        wanted.join(spans.select(*EVENT, "etd"), EVENT, "left")
        .join(counts, EVENT, "left")
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select(*EVENT, "reason")
    )
    return Study(windows, rejected, model, off)


def _expected(fitted: DataFrame, model: str) -> DataFrame:
    """Event-window rows with the model's expected and abnormal return."""
    names = MODEL_FACTORS[model]
    if model == "madj":
        fitted = fitted.withColumns({"rsq": F.lit(0.0), "p_count": F.lit(1), "edf": F.col("nobs") - 1})
    else:
        if model != "m":
            fitted = fitted.withColumn("fit", leastsq.fit_only("fit_n", "fit_means", "fit_cov")).withColumns(
                {
                    "alpha": F.col("fit.coef")[0],
                    "betas": F.slice("fit.coef", 2, len(names)),
                    "var_estp": F.col("fit.mse"),
                    "rsq": F.col("fit.rsq"),
                }
            )
        # two parameters are reported for every regression model, as published
        fitted = fitted.withColumns({"p_count": F.lit(2), "edf": F.col("nobs") - 2})
    keep = [*EVENT, "nobs", "alpha", "var_estp", "rsq", "p_count", "edf"]
    keep += {"madj": [], "m": ["beta"]}.get(model, ["betas"])
    rows = fitted.select(*keep, F.inline("rows"))
    if model == "madj":
        expected, abnormal = F.col("mkt"), F.col("exret")
    else:
        expected = F.col("alpha")
        for i, name in enumerate(names):
            beta = F.col("beta") if model == "m" else F.col("betas")[i]
            expected = expected + beta * F.col(name)
        abnormal = F.col("ret") - expected
    return rows.withColumns({"expret": expected, "abret": abnormal}).drop("beta", "betas")


def _accumulate(rows: DataFrame, off: Offsets) -> DataFrame:
    by_time = Window.partitionBy(*EVENT).orderBy("evttime")
    upto = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = by_time.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sd = F.sqrt("var_estp")
    scale = F.try_divide(F.col("nobs") - F.lit(2.0), F.col("nobs") - F.lit(4.0))
    out = (
        rows.withColumns(
            {
                "cret": F.product(1 + F.col("ret")).over(upto) - 1,
                "cexpret": F.product(1 + F.col("expret")).over(upto) - 1,
                "car": F.sum("abret").over(upto),
            }
        )
        .withColumns(
            {
                "sar": F.try_divide(F.col("abret"), sd),
                "scar": F.try_divide(F.col("car"), F.sqrt(off.length * F.col("var_estp"))),
                "bhar": F.col("cret") - F.col("cexpret"),
                "pat_scale": scale,
                "pat_scale_edate": scale,
            }
        )
    )
    final = {f"{c}_edate": F.last(c).over(whole) for c in ("cret", "car", "scar", "sar", "bhar")}
    return out.withColumns(final).withColumns(
        {"evtid": dates.event_id(F.col("edate"), F.col("permno")), "rmse": sd}
    )


def cross_section(windows: DataFrame) -> DataFrame:
    """Means, deviations, counts and test statistics by event time."""
    means = {
        "abret_m": "abret", "bhar_edate_m": "bhar_edate", "car_edate_m": "car_edate", "car_m": "car",
        "cret_edate_m": "cret_edate", "pat_scale_m": "pat_scale", "ret_m": "ret", "sar_m": "sar",
        "scar_edate_m": "scar_edate", "scar_m": "scar",
    }
    spreads = ["car", "abret", "sar", "pat_scale", "car_edate", "scar_edate", "scar"]
    sized = ["scar", "scar_edate", "sar", "car"]
    base = windows.groupBy("evttime").agg(
        *[F.avg(c).alias(n) for n, c in means.items()],
        *[F.stddev_samp(c).alias(f"{c}_v") for c in spreads],
        *[F.count(c).alias(f"{c}_n") for c in sized],
        F.count("evttime").alias("n"),
        F.coalesce(F.sum("pat_scale_edate"), F.lit(0.0)).alias("pat_scale_edate_s"),
        F.coalesce(F.sum("pat_scale"), F.lit(0.0)).alias("pat_scale_s"),
    )

    def t_value(mean: str, spread: str, n: str) -> Column:
        return F.try_divide(F.col(mean), F.try_divide(F.col(spread), F.sqrt(n)))

    def patell(mean: str, scale: str, n: str) -> Column:
        return F.try_divide(F.col(mean), F.try_divide(F.sqrt(scale), F.col(n)))

    return base.withColumns(
        {
            "pat_car_edate_mean": F.lit(0),
            "abret_t": t_value("abret_m", "abret_v", "n"),
            "sar_t": t_value("sar_m", "sar_v", "n"),
            "car_edate_t": t_value("car_edate_m", "car_edate_v", "n"),
            "scar_edate_t": t_value("scar_edate_m", "scar_edate_v", "scar_edate_n"),
            "pat_car": patell("scar_m", "pat_scale_s", "scar_n"),
            "pat_car_edate_m": patell("scar_edate_m", "pat_scale_edate_s", "scar_edate_n"),
            "pat_ar": patell("sar_m", "pat_scale_s", "sar_n"),
        }
    )
