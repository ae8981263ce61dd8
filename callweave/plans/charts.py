"""The data behind the charts; drawing is left to the reader of the frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators import relational, scan


def mean_with_interval(df: DataFrame, keys: Sequence[str], value: str, z: float = 1.96) -> DataFrame:
    """Mean and normal interval per group."""
    base = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_sd")
    )
    half = z * F.col("_sd") / F.sqrt("n")
    return base.withColumns({"low": F.col("mean") - half, "high": F.col("mean") + half}).drop("_sd")


def medians(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return scan.quantiles(df, keys, value, {"median": 0.5})


def coefficient_forest(summary: DataFrame, z: float = 1.96) -> DataFrame:
    """Sentiment coefficients with their intervals and stars."""
    half = z * F.col("Std_Error")
    coef = F.col("Sentiment_Coef")
    return summary.select(
        "Theme_ID", "Theme_Name", "Significance", coef.alias("coef"), (coef - half).alias("low"), (coef + half).alias("high")
    )


def theme_overview(themes: DataFrame) -> DataFrame:
    return themes.select("theme_id", "name", "n_topics", "n_firms").orderBy(F.desc("n_topics"), "theme_id")


def firm_theme_heatmap(topics: DataFrame, theme_ids: Sequence) -> DataFrame:
    """Sentences per firm and theme, absent cells 0."""
    return relational.pivot_sum(topics, "firm_id", "theme_id", theme_ids, "n_sentences")


def topics_per_firm(topics: DataFrame) -> DataFrame:
    return topics.groupBy("firm_id").agg(F.count_distinct("topic_id").alias("n_topics"))


def portfolio_lines(combined: DataFrame) -> DataFrame:
    return combined.select("bucket", "days_from_event", "cumulative_return").orderBy("bucket", "days_from_event")
