"""Cross-firm themes: topic documents, grouping, validation and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions import dates, text
from callweave.functions.fixed import MAX_DOMINANCE, MIN_FIRMS
from callweave.operators import scan
from callweave.plans.topics import NOISE


def topic_documents(topics: DataFrame) -> DataFrame:
    """Text of each topic for theme modelling: its summary, else its representation; empty ones drop."""
    summary = F.coalesce(text.missing_text(F.col("summary")), F.col("representation"))
    return topics.withColumn("summary", summary).withColumn("document", summary).filter(
        text.missing_text(F.col("document")).isNotNull()
    )


def theme_groups(assigned: DataFrame, theme: str = "theme", firm: str = "firm_id") -> DataFrame:
    """Topic count, firm count and the largest firm share per theme; noise left out.

    Counting by (theme, firm) first spreads a huge theme over its firms.
    """
    per_firm = assigned.filter(F.col(theme) != NOISE).groupBy(theme, firm).agg(F.count(F.lit(1)).alias("_n"))
    return per_firm.groupBy(theme).agg(
        F.sum("_n").alias("n_topics"),
        F.count(firm).alias("n_firms"),
        (F.max("_n") / F.sum("_n")).alias("dominance"),
    )


def valid_themes(groups: DataFrame, min_firms: int = MIN_FIRMS, max_dominance: float = MAX_DOMINANCE) -> DataFrame:
    return groups.filter((F.col("n_firms") >= min_firms) & (F.col("dominance") <= max_dominance))


def with_theme_ids(groups: DataFrame, run_date: Column, theme: str = "theme") -> DataFrame:
    """Ordinal by falling topic count (theme number on ties) and the dated theme id."""
    placed = scan.running(groups, [], [F.desc("n_topics"), F.col(theme)], _rn=scan.rows())
    ordinal = F.col("_rn") - 1
    return placed.withColumns({"ordinal": ordinal, "theme_id": dates.theme_id(run_date, ordinal)}).drop("_rn")


def theme_topics(assigned: DataFrame, themes: DataFrame, theme: str = "theme", part_rows: int = 10_000) -> DataFrame:
    """Topic lists of the kept themes, in parts of bounded length."""
    member = F.struct("firm_id", "topic_id", "representation", "summary", "size")
    kept = assigned.join(themes.select(theme), theme, "left_semi")
    return scan.ordered_lists(kept, [theme], [F.col("firm_id"), F.col("topic_id")], member, "topics", part_rows)


def aggregate_themes(
    assigned: DataFrame,
    run_date: Column,
    min_firms: int = MIN_FIRMS,
    max_dominance: float = MAX_DOMINANCE,
) -> DataFrame:
    """Validated themes, numbered by size."""
    return with_theme_ids(valid_themes(theme_groups(assigned), min_firms, max_dominance), run_date)
