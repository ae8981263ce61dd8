"""Export of the hierarchy as theme contributions for the sentiment stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators import scan
from callweave.plans.store import upper_ticker_permno

KEYS = ["theme_id", "theme_name", "firm_id", "firm_name", "permno", "earnings_call_date"]


def contributions(flat: DataFrame, stocknames: DataFrame | None = None, part_rows: int = 10_000) -> DataFrame:
    """One row per theme, firm and part with the firm's sentences of all topics of the theme.

    `flat` is `store.hierarchy`. The firm id is exported (the reader needs it), and the PERMNO
    looked up by ticker and call date when name records are given.
    """
    rows = flat.withColumn("permno", F.lit(None).cast("bigint"))
    if stocknames is not None:
        asked = flat.select("ticker", F.col("earnings_call_date").alias("date"))
        found = upper_ticker_permno(asked, stocknames).select(
            F.col("ticker").alias("_t"), F.col("date").alias("_d"), F.col("permno").alias("_p")
        )
        hit = (F.upper("ticker") == F.col("_t")) & (F.col("earnings_call_date") == F.col("_d"))
        rows = flat.join(found, hit, "left").withColumn("permno", F.col("_p")).drop("_t", "_d", "_p")
    shaped = rows.withColumns(
        {
            "theme_id": F.format_string("theme_%03d", "theme_id"),
            "firm_id": F.col("company_id"),
            "earnings_call_date": F.date_format("earnings_call_date", "yyyy-MM-dd"),
        }
    )
    sentence = F.struct(F.col("raw_text").alias("text"), F.coalesce("speaker_type", F.lit("")).alias("speaker"))
    order = [F.col("topic_id"), F.col("position"), F.col("sentence_id")]
    return scan.ordered_lists(shaped, KEYS, order, sentence, "sentences", part_rows)


def export_lines(parts: DataFrame) -> DataFrame:
    """Rows in the layout of a themes document, one contribution part per line."""
    contribution = F.struct("firm_id", "firm_name", "permno", "earnings_call_date", "sentences")
    return parts.select("theme_id", "theme_name", F.array(contribution).alias("firm_contributions"))


def write_export(parts: DataFrame, path: str) -> None:
    """JSON lines; every line is a document that `sources.documents.theme_rows` reads back."""
    export_lines(parts).write.mode("overwrite").json(path)
