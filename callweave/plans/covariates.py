"""Firm covariates: fundamentals, link histories, monthly prices and the event results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions import nulls
from callweave.functions.fixed import COVARIATES, LINK_PRIMARY, LINK_TYPES
from callweave.operators import scan
from callweave.operators.asof import asof_join
from callweave.operators.intervals import interval_join
from callweave.plans.eventstudy import Study
from callweave.session import materialize

QUARTERLY = {
    "epsfxq": "eps_q", "ibq": "net_income_q", "atq": "total_assets_q", "dlttq": "total_debt_q",
    "lctq": "current_liabilities_total_q", "teqq": "shareholders_equity_q", "capxy": "capex_q",
    "cheq": "cash_and_short_term_investments_q", "ppentq": "ppe_q",
    "xrdq": "research_and_development_expense_q",
}
FORMAT_KEYS = ["gvkey", "datadate", "datafmt", "consol", "indfmt"]


def monthly_features(msf: DataFrame) -> DataFrame:
    """Price, cap, 12-month volatility and 3-month return; NULL until the window is full."""
    by = ["permno", "cusip"]
    base = msf.withColumns(
        {
            "prc": F.abs("prc"),
            "cap": F.abs("prc") * F.col("shrout"),
            "ret_sqd": F.col("ret") * F.col("ret"),
            "gross_ret": F.col("ret") + 1,
        }
    )

    def volatility(ordered, frame) -> Column:
        full = F.count("ret_sqd").over(frame) == 12
        return nulls.keyed(by, F.when(full, F.sqrt(F.sum("ret_sqd").over(frame))))

    def growth(ordered, frame) -> Column:
        short = ordered.rowsBetween(-2, 0)
        full = F.count("gross_ret").over(short) == 3
        return nulls.keyed(by, F.when(full, F.product("gross_ret").over(short) - 1))

    return scan.trailing(
        base, by, [F.col("date")], 11, {"Stock_Volatility": volatility, "Stock_Return": growth}
    ).drop("ret_sqd", "gross_ret")


def quarterly_statements(fundq: DataFrame, funda: DataFrame) -> DataFrame:
    standard = (F.col("datafmt") == "STD") & (F.col("consol") == "C")
    annual = funda.filter(standard).select(*FORMAT_KEYS, "sale", F.col("emp").alias("employees"))
    return (
        fundq.filter(standard)
        .join(annual, FORMAT_KEYS, "left")
        .select(
            "gvkey", "datadate", "fyearq", "fqtr", "fyr", "tic",
            *[F.col(c).alias(n) for c, n in QUARTERLY.items()], "sale", "employees",
        )
        .distinct()
    )


def latest_estimates(statsum: DataFrame) -> DataFrame:
    """Newest quarterly EPS estimate per ticker and period end."""
    eps = statsum.filter((F.col("measure") == "EPS") & (F.col("fiscalp") == "QTR"))
    newest = scan.top_k(eps, ["ticker", "fpedats"], [F.desc("statpers"), F.col("numest"), F.col("meanest")], 1)
    return newest.select(
        F.col("ticker").alias("ibes_ticker"), "fpedats", "measure", "meanest", "medest", "actual"
    )


def fundamentals(
    events: DataFrame,
    fundq: DataFrame,
    funda: DataFrame,
    links: DataFrame,
    stocknames: DataFrame,
    ibes_links: DataFrame,
    statsum: DataFrame,
    msf: DataFrame,
) -> DataFrame:
    """Quarterly statements of the event firms with names, estimates and month-end prices."""
    wanted = events.select(F.col("permno").alias("lpermno")).distinct()
    active = (
        links.filter(F.col("linktype").isin(LINK_TYPES) & F.col("linkprim").isin(LINK_PRIMARY))
        .join(wanted, "lpermno", "left_semi")
        .select("gvkey", "lpermno", "linkdt", "linkenddt")
    )
    linked = interval_join(
        quarterly_statements(fundq, funda), active, ["gvkey"], "datadate", "linkdt", "linkenddt"
    ).withColumnRenamed("lpermno", "permno").drop("linkdt", "linkenddt")
    names = stocknames.select("permno", "ticker", "comnam", "namedt", "nameendt")
    named = interval_join(linked, names, ["permno"], "datadate", "namedt", "nameendt").drop("namedt", "nameendt")
    history = ibes_links.select(
        "permno", F.col("ticker").alias("ibes_ticker"), "sdate", F.col("edate").alias("ibes_end")
    )
    tracked = interval_join(named, history, ["permno"], "datadate", "sdate", "ibes_end", how="left").drop(
        "sdate", "ibes_end"
    )
    estimates = latest_estimates(statsum).withColumn("datadate", F.col("fpedats"))
    pulled = tracked.join(estimates, ["ibes_ticker", "datadate"], "left").drop("ibes_ticker").distinct()
    prices = monthly_features(msf.join(wanted.withColumnRenamed("lpermno", "permno"), "permno", "left_semi"))
    take = {c: c for c in ("date", "prc", "cap", "ret", "Stock_Volatility", "Stock_Return")}
    return asof_join(
        pulled, prices, ["permno"], "datadate", "date", take, tie=["cusip"], within_days=31
    )


def ratios(divide: Callable[[Column, Column], Column] = F.try_divide) -> dict[str, Column]:
    """Covariate formulas on statement columns; division by zero gives NULL, or what `divide` gives."""
    c = F.col
    assets = c("total_assets_q")
    debt = c("total_debt_q") + c("current_liabilities_total_q")

    def per_assets(value: Column) -> Column:
        return divide(value, assets)

    return {
        "Return_on_Assets": per_assets(c("net_income_q")),
        "Book_Leverage": divide(debt, debt + c("shareholders_equity_q")),
        "Capital_Expenditures": per_assets(c("capex_q")),
        "Research_and_Development": per_assets(c("research_and_development_expense_q")),
        "Sales_Growth": divide(c("sale"), c("sale_lagged")),
        "Firm_Size": F.ln("sale"),
        "Cash": per_assets(c("cash_and_short_term_investments_q")),
        "Asset_Tangibility": per_assets(c("ppe_q")),
        "Market_to_Book": per_assets(
            c("cap") + c("total_debt_q") - c("cash_and_short_term_investments_q")
        ),
        "Earnings_Surprise": (c("actual") - c("medest")) * c("prc"),
        "Delta_Employee_Change": per_assets(c("employees") - c("employees_lagged")),
    }


def covariates(pulled: DataFrame, divide: Callable[[Column, Column], Column] = F.try_divide) -> DataFrame:
    """Annual figures carried forward up to three quarters, prior-year values and the ratios."""
    group = ["permno", "ticker"]
    pulled = materialize(pulled)

    def carried(name: str):
        return lambda ordered, frame: nulls.keyed(group, F.last(name, ignorenulls=True).over(frame))

    filled = scan.trailing(
        pulled, group, [F.col("datadate"), F.col("gvkey"), F.col("fyearq"), F.col("fqtr")], 3,
        {"_sale": carried("sale"), "_employees": carried("employees")},
    ).drop("sale", "employees").withColumnsRenamed({"_sale": "sale", "_employees": "employees"})
    season = ["permno", "ticker", "fqtr"]

    def prior(name: str):
        return lambda ordered, frame: nulls.keyed(season, F.lag(name, 1).over(ordered))

    lagged = scan.trailing(
        filled, season, [F.col("fyearq"), F.col("datadate"), F.col("gvkey")], 1,
        {"sale_lagged": prior("sale"), "employees_lagged": prior("employees")},
    )
    return lagged.withColumns(ratios(divide))


def event_covariates(
    study: Study, factors: DataFrame, events: DataFrame, complete: Callable[[DataFrame], DataFrame] = nulls.finite_rows
) -> DataFrame:
    """Complete rows of event results with the newest statement strictly before the event,
    joined back to every event of the same firm and date. `complete` keeps the rows that count as such."""
    take = {c: c for c in ("datadate", "ticker", "comnam", *COVARIATES)}
    tie = ["fyearq", "fqtr", "gvkey", "ticker"]
    # one row per permno and date on both sides, as equal statement dates are merged
    joined = asof_join(
        study.event_date, factors, ["permno"], "edate", "datadate", take, tie=tie, strict=True, bounded=True
    )
    columns = ["permno", "edate", "datadate", "ticker", "comnam", *COVARIATES, "cret", "car", "bhar"]
    return complete(joined.select(*columns)).join(events, ["permno", "edate"], "left")
