"""Per-theme regressions of event returns on sentiment and covariates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions import leastsq, text
from callweave.functions.fixed import COVARIATES
from callweave.operators import scan
from callweave.session import materialize


def fit_groups(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], carry: dict[str, Column] | None = None) -> DataFrame:
    """OLS of `y` on a constant and `xs` per group, from sums merged before the shuffle; `carry` adds aggregates."""
    sums = df.groupBy(*keys).agg(*leastsq.moments(F.col(y), [F.col(x) for x in xs]), *[f.alias(n) for n, f in (carry or {}).items()])
    return sums.withColumn("fit", leastsq.fit("fit_n", "fit_means", "fit_cov")).select(
        *keys, *(carry or {}), F.col("fit_n").alias("n_obs"), "fit.*"
    )


def theme_regressions(results: DataFrame, covariates: Sequence[str] = COVARIATES, y: str = "car") -> DataFrame:
    return fit_groups(results, ["theme_id"], y, ["sentiment", *covariates], {"theme_name": F.min("theme_name")})


def coefficient_table(fits: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per group and coefficient, the constant first."""
    labels = F.array(*[F.lit(n) for n in ("const", *names)])
    rows = F.arrays_zip(labels.alias("term"), "coef", "se", "t", "p")
    table = fits.select(*keys, "n_obs", "rsq", "adj_rsq", F.posexplode(rows).alias("position", "row"))
    return table.select(*keys, "position", "row.*", "n_obs", "rsq", "adj_rsq")


def significance_summary(fits: DataFrame) -> DataFrame:
    """Sentiment coefficient per theme, ranked by p-value (NaN last)."""
    def second(c: str):
        return F.element_at(c, 2)

    rows = fits.select(
        F.col("theme_id").alias("Theme_ID"),
        F.col("theme_name").alias("Theme_Name"),
        second("coef").alias("Sentiment_Coef"),
        second("se").alias("Std_Error"),
        second("t").alias("t_Statistic"),
        second("p").alias("p_Value"),
        text.stars(second("p")).alias("Significance"),
        F.col("rsq").alias("R_Squared"),
        F.col("adj_rsq").alias("Adj_R_Squared"),
        F.col("n_obs").alias("N_Observations"),
    )
    return scan.running(materialize(rows), [], [F.col("p_Value").asc_nulls_last(), F.col("Theme_ID")], rank=scan.rows())


def summary_stats(summary: DataFrame) -> DataFrame:
    p, coef = F.col("p_Value"), F.col("Sentiment_Coef")
    n = F.count(F.lit(1))
    below = {"05": 0.05, "01": 0.01, "001": 0.001}
    return summary.agg(
        n.alias("n_themes"),
        *[F.count_if(p < v).alias(f"n_below_{k}") for k, v in below.items()],
        *[F.try_divide(100.0 * F.count_if(p < v), n).alias(f"pct_below_{k}") for k, v in below.items()],
        F.count_if(coef > 0).alias("n_positive"),
        F.count_if(coef < 0).alias("n_negative"),
        F.avg("R_Squared").alias("mean_r_squared"),
        F.avg(F.abs(coef)).alias("mean_abs_coef"),
    )


RULE = "-" * 100
HEADING = [
    "Sentiment coefficients by p-value",
    "Themes in the order in which their sentiment explains cumulative abnormal returns.",
    "*** p < 0.001, ** p < 0.01, * p < 0.05",
    RULE,
]


def summary_report(summary: DataFrame) -> DataFrame:
    """The text report as lines (section, rank, part, line): heading, ranked table, statistics and the first three themes."""
    spark = summary.sparkSession
    columns = F.format_string("%-6s %-50s %10s %10s %5s %6s %8s", *[F.lit(c) for c in ("Rank", "Theme", "Coef", "p", "Sig", "N", "R2")])
    heading = spark.range(1).select(F.array(*[F.lit(t) for t in HEADING], columns, F.lit(RULE)).alias("lines"))
    name = text.shorten(F.col("Theme_Name"))
    table = F.format_string(
        "%-6d %-50s %+10.6f %10.4f %5s %6d %8.4f",
        "rank", name, "Sentiment_Coef", "p_Value", "Significance", "N_Observations", "R_Squared",
    )

    def share(label: str, count: str) -> Column:
        n = F.col("n_themes")
        return F.format_string(f"  {label}: %d (%.1f%%)", count, F.coalesce(F.try_divide(100.0 * F.col(count), n), F.lit(0.0)))

    totals = [
        F.lit(RULE), F.lit("Statistics"),
        F.format_string("  Themes: %d", "n_themes"),
        share("p < 0.05", "n_below_05"), share("p < 0.01", "n_below_01"), share("p < 0.001", "n_below_001"),
        share("Positive coefficients", "n_positive"), share("Negative coefficients", "n_negative"),
        F.format_string("  Mean R2: %.4f", F.coalesce("mean_r_squared", F.lit(0.0))),
        F.format_string("  Mean absolute coefficient: %.6f", F.coalesce("mean_abs_coef", F.lit(0.0))),
        F.lit(RULE), F.lit("Most significant themes"),
    ]
    best = [
        F.format_string("  %d. %s", "rank", "Theme_Name"),
        F.format_string("     coefficient %+.6f%s, p %.6f, t %+.4f", "Sentiment_Coef", "Significance", "p_Value", "t_Statistic"),
        F.format_string("     R2 %.4f, N %d", "R_Squared", "N_Observations"),
    ]
    sections = [
        heading.withColumn("rank", F.lit(0).cast("long")),
        summary.select(F.array(table).alias("lines"), "rank"),
        summary_stats(summary).select(F.array(*totals).alias("lines"), F.lit(0).cast("long").alias("rank")),
        summary.filter(F.col("rank") <= 3).select(F.array(*best).alias("lines"), "rank"),
    ]
    parts = [s.select(F.lit(n).alias("section"), "rank", F.posexplode("lines").alias("part", "line")) for n, s in enumerate(sections)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
