"""Components to cleaned sentences with stable ids and positions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions import text
from callweave.operators import scan


def sentences(
    components: DataFrame,
    stopwords: Sequence[str],
    split: Callable[[Column], Column] = text.split_sentences,
    clean: Callable[[Column, Sequence[str]], Column] = text.clean,
    min_words: int = 2,
) -> DataFrame:
    """One row per kept sentence, numbered from 0 inside each firm.

    Sentences with fewer than `min_words` cleaned words are dropped before numbering. Order is
    transcript (by number, other ids after the numbers), component, text hash for equal component numbers, then
    place in the text.
    `split` and `clean` take any column expression, so a tagger can stand in.
    """
    pieces = F.transform(split(F.col("text")), lambda s: F.struct(s.alias("raw"), clean(s, stopwords).alias("cleaned")))
    kept = F.filter(pieces, lambda s: F.size(F.split(F.trim(s["cleaned"]), r"\s+")) >= min_words)
    counted = components.withColumn("_kept", kept).withColumn("_n", F.size("_kept")).withColumn("_tie", F.xxhash64("text"))
    # no filter on the count: it would be pushed below and split the texts a second time
    counted = counted.drop("text")
    order = [F.col("transcript_id").try_cast("bigint").asc_nulls_last(), *[F.col(c) for c in ("transcript_id", "component_order", "_tie")]]
    placed = scan.running(counted, ["firm_id"], order, _upto=scan.total(F.col("_n")))
    start = F.col("_upto") - F.col("_n")
    rows = placed.select(
        "firm_id", "transcript_id", "component_order", "speaker_type", start.alias("_start"),
        F.posexplode("_kept").alias("_at", "_s"),
    )
    position = F.col("_start") + F.col("_at")
    return rows.select(
        text.sentence_id(F.col("firm_id"), F.col("transcript_id"), position).alias("sentence_id"),
        "firm_id", "transcript_id", "component_order", "speaker_type",
        position.alias("position"),
        F.col("_s.raw").alias("raw_text"),
        F.col("_s.cleaned").alias("cleaned_text"),
    )


def firm_metadata(components: DataFrame, start: str, end: str) -> DataFrame:
    """Transcript and component counts per firm; the name of the least transcript stands for the firm."""
    return components.groupBy("firm_id").agg(
        F.min_by("firm_name", F.struct("transcript_id", "component_order")).alias("firm_name"),
        F.count_distinct("transcript_id").alias("n_transcripts"),
        F.count(F.lit(1)).alias("n_components"),
        F.lit(f"{start} to {end}").alias("date_range"),
    )
