"""Tercile portfolios by event sentiment, for all themes in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions.fixed import BUCKETS, PORTFOLIO_DAYS, PORTFOLIO_PULL_DAYS, TERCILE_PROBS
from callweave.operators import scan
from callweave.operators.asof import asof_join
from callweave.operators.intervals import interval_join
from callweave.session import materialize

THEME = ["theme_id", "theme_name"]


def event_days(
    events: DataFrame,
    returns: DataFrame,
    days: int = PORTFOLIO_DAYS,
    pull_days: int = PORTFOLIO_PULL_DAYS,
) -> DataFrame:
    """Return rows of each event from its date on, counted from 0 up to `days`.

    Return rows are numbered once per permno (one row per permno and date, so a group is a
    calendar long); each event looks up its first row and meets only the cells it touches.
    """
    series = Window.partitionBy("permno").orderBy("date")
    # only the events' firms, from their first event on; the numbering may start anywhere
    firms = events.groupBy("permno").agg(F.min("edate").alias("first"))
    numbered = (
        returns.select("permno", "date", "prc", "ret", "shrout")
        .join(firms, "permno")
        .filter(F.col("date") >= F.col("first"))
        .drop("first")
        .withColumn("rn", F.row_number().over(series))
    )
    # a theme goes by its id and carries the first of its names
    ends = events.groupBy("theme_id").agg(
        F.date_add(F.max("edate"), pull_days).alias("pull_end"), F.min("theme_name").alias("theme_name")
    )
    # distinct dates of a permno are bounded by the calendar, so no size check is needed
    starts = asof_join(
        events.select("permno", "edate").distinct(), numbered, ["permno"], "edate", "date", {"rn": "rn0"},
        direction="forward", bounded=True,
    ).filter(F.col("rn0").isNotNull())
    located = events.drop("theme_name").join(ends, "theme_id").join(starts, ["permno", "edate"])
    spans = located.withColumn("rn_end", F.col("rn0") + days)
    met = interval_join(numbered, spans, ["permno"], "rn", "rn0", "rn_end", width=128, floor=0, ceiling=2**31)
    return met.filter(F.col("date") <= F.col("pull_end")).select(
        *THEME, "permno", "edate", "sentiment", "date", "ret",
        (F.abs("prc") * F.col("shrout")).alias("mktcap"),
        (F.col("rn") - F.col("rn0")).cast("long").alias("days_from_event"),
    )


def sentiment_buckets(rows: DataFrame) -> DataFrame:
    """Low, Medium or High against the day's terciles; NULL sentiment is High."""
    cuts = scan.quantiles(rows, ["theme_id", "days_from_event"], "sentiment", TERCILE_PROBS)
    low, mid = F.col("sentiment") <= F.col("q33"), F.col("sentiment") <= F.col("q67")
    bucket = F.when(low, BUCKETS[0]).when(mid, BUCKETS[1]).otherwise(BUCKETS[2])
    return rows.join(cuts, ["theme_id", "days_from_event"], "left").withColumn("bucket", bucket).drop("q33", "q67")


def portfolio_returns(
    events: DataFrame,
    returns: DataFrame,
    weighting: str = "value",
    days: int = PORTFOLIO_DAYS,
    pull_days: int = PORTFOLIO_PULL_DAYS,
) -> DataFrame:
    """Bucket return and compounded return by theme, bucket and day; day 0 always exists with 0."""
    if weighting not in ("value", "equal"):
        raise ValueError(f"unknown weighting: {weighting}")
    # read by the terciles and by the sort itself, so written once
    bucketed = sentiment_buckets(materialize(event_days(events, returns, days, pull_days)))
    if weighting == "equal":
        value = F.avg("ret")
    else:
        cap = F.coalesce(F.sum("mktcap"), F.lit(0.0))
        broken = (F.count("ret") < F.count(F.lit(1))) | (F.count("mktcap") < F.count(F.lit(1)))
        value = (
            F.when(cap <= 0, 0.0)
            .when(broken, F.lit(None))
            .otherwise(F.try_divide(F.sum(F.col("ret") * F.col("mktcap")), cap))
        )
    daily = bucketed.groupBy(*THEME, "bucket", "days_from_event").agg(value.alias("vw_return"))
    return compound(with_day_zero(daily))


def with_day_zero(daily: DataFrame) -> DataFrame:
    """The series with a row for day 0 in each, found in one pass over its at most `days` rows."""
    series = Window.partitionBy(*THEME, "bucket")
    own = F.struct("days_from_event", "vw_return")
    zero = F.struct(F.lit(0).cast("long").alias("days_from_event"), F.lit(0.0).alias("vw_return"))
    first = F.col("days_from_event") == F.min("days_from_event").over(series)
    lacking = first & (F.count_if(F.col("days_from_event") == 0).over(series) == 0)
    rows = daily.withColumn("_rows", F.when(lacking, F.array(own, zero)).otherwise(F.array(own)))
    return rows.select(*THEME, "bucket", F.inline("_rows"))


def compound(daily: DataFrame) -> DataFrame:
    """Compounded return over days 1..d; a missing day return leaves all later days NULL."""
    upto = (
        Window.partitionBy(*THEME, "bucket")
        .orderBy("days_from_event")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    later = F.col("days_from_event") > 0
    growth = F.product(F.when(later, 1 + F.col("vw_return")).otherwise(1.0)).over(upto) - 1
    gaps = F.sum(F.when(later & F.col("vw_return").isNull(), 1).otherwise(0)).over(upto)
    return daily.withColumn(
        "cumulative_return", F.when(~later, 0.0).when(gaps > 0, F.lit(None)).otherwise(growth)
    )


def combined(portfolio: DataFrame, days: int = PORTFOLIO_DAYS) -> DataFrame:
    """Average over themes by bucket and day."""
    return (
        portfolio.filter(F.col("days_from_event").between(0, days))
        .groupBy("bucket", "days_from_event")
        .agg(
            F.avg("vw_return").alias("vw_return"),
            F.avg("cumulative_return").alias("cumulative_return"),
            F.count_distinct("theme_id").alias("n_themes"),
        )
    )


def spread(series: DataFrame, keys: list[str] | None = None, days: int = PORTFOLIO_DAYS) -> DataFrame:
    """High and Low compounded return on the last day of the High series, and their difference."""
    keys = keys or []

    def of(bucket: str):
        return F.max(F.when(F.col("bucket") == bucket, F.col("cumulative_return")))

    by_day = (
        series.filter(F.col("days_from_event") <= days)
        .groupBy(*keys, "days_from_event")
        .agg(
            of("High").alias("high"),
            of("Low").alias("low"),
            F.count_if(F.col("bucket") == "High").alias("has_high"),
        )
        .filter("has_high > 0")
    )
    last = F.max_by(F.struct("days_from_event", "high", "low"), "days_from_event")
    return by_day.groupBy(*keys).agg(last.alias("at")).select(
        *keys,
        F.col("at.days_from_event").alias("last_day"),
        F.col("at.high").alias("high_return"),
        F.col("at.low").alias("low_return"),
        (F.col("at.high") - F.col("at.low")).alias("spread"),
    )
