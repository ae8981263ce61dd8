"""Sentence sentiment, its aggregation to firm and theme, and the resulting events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IndexToString, Normalizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions import dates, text
from callweave.session import materialize

POSITIVE, NEGATIVE, NEUTRAL = "positive", "negative", "neutral"
GROUP = ["theme_id", "theme_name", "firm_id", "firm_name", "permno", "earnings_call_date"]


def lexicon_label(sentence: Column, positive: Sequence[str], negative: Sequence[str]) -> tuple[Column, Column]:
    """Label and confidence from counts of listed words; the default where no classifier is given."""
    words = text.tokens(sentence)

    def hits(listed: Sequence[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*listed)))

    good, bad = hits(positive), hits(negative)
    label = F.when(good > bad, POSITIVE).when(bad > good, NEGATIVE).otherwise(NEUTRAL)
    score = F.coalesce(F.try_divide(F.abs(good - bad).cast("double"), good + bad), F.lit(1.0))
    return label, F.when(label == NEUTRAL, 1.0 - F.when(good + bad > 0, score).otherwise(0.0)).otherwise(score)


def word_model(labelled: DataFrame, features: int = 1 << 15, penalty: float = 1e-5, text_column: str = "text", label: str = "label") -> PipelineModel:
    """Classifier of sentences from labelled ones: multinomial logistic regression on the hashed counts of words and word pairs, at length one.

    Rows without a label are left out. The fit sums gradients where the rows are; what it returns is one weight per feature and label.
    """
    featured = _featured(labelled.filter(F.col(label).isNotNull()), features, text_column)
    known = materialize(featured.select(label, "_features"))  # the fit reads them more than once
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc")
    fit = LogisticRegression(featuresCol="_features", labelCol="_label", regParam=penalty, standardization=False, probabilityCol="_share", predictionCol="_class", rawPredictionCol="_raw")
    named = index.fit(known)
    back = IndexToString(inputCol="_class", outputCol="_name", labels=named.labels)
    return PipelineModel([named.setHandleInvalid("keep"), fit.fit(named.transform(known)), back])


def _featured(rows: DataFrame, features: int, text_column: str) -> DataFrame:
    # the tokens are a column of their own: the n-grams name them several times, and each would split the text again
    worded = rows.withColumn("_words", text.tokens(F.coalesce(F.col(text_column), F.lit(""))))
    grams = worded.withColumn("_grams", text.ngrams(F.col("_words"), 1, 2)).drop("_words")
    counted = HashingTF(inputCol="_grams", outputCol="_counts", numFeatures=features).transform(grams)
    return Normalizer(inputCol="_counts", outputCol="_features").transform(counted)


def learned(sentences: DataFrame, model: PipelineModel, text_column: str = "text") -> DataFrame:
    """`sentences` with the label that a `word_model` finds likeliest, and its probability as score; texts without words go by the labels' shares."""
    fitted = model.stages[1]
    rows = _featured(sentences.drop("label", "score"), fitted.numFeatures, text_column)
    found = model.stages[2].transform(fitted.transform(rows))
    likeliest = F.array_max(vector_to_array("_share"))
    return found.select(*[c for c in sentences.columns if c not in ("label", "score")], F.col("_name").alias("label"), likeliest.alias("score"))


def classified(sentences: DataFrame, classifier, batch: int = 32) -> DataFrame:
    """Labels from `classifier()`, a factory for predict(list[str]) -> [(label, score)], in batches."""
    schema = sentences.withColumns({"label": F.lit(""), "score": F.lit(0.0)}).schema

    def run(frames):
        predict = classifier()
        for frame in frames:
            texts = list(frame["text"])
            found = [p for i in range(0, len(texts), batch) for p in predict(texts[i : i + batch])]
            yield frame.assign(label=[str(a).lower() for a, _ in found], score=[float(s) for _, s in found])

    return sentences.mapInPandas(run, schema)


def label_counts(n: Column | None = None) -> list[Column]:
    each = [F.count_if(F.col("label") == v).alias(f"{v}_count") for v in (POSITIVE, NEGATIVE, NEUTRAL)]
    return [*each, (n if n is not None else F.count("label")).alias("total_count")]


def distribution(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, score, shares and confidence range per group; an empty input gives zeros."""
    counted = labelled.groupBy(*keys).agg(
        *label_counts(),
        F.avg("score").alias("avg_confidence"),
        F.min("score").alias("min_confidence"),
        F.max("score").alias("max_confidence"),
    )
    total = F.col("total_count")

    def share(value: Column) -> Column:
        return F.coalesce(F.try_divide(value.cast("double"), total), F.lit(0.0))

    return counted.withColumns(
        {
            "sentiment_score": share(F.col("positive_count") - F.col("negative_count")),
            **{f"{v}_ratio": share(F.col(f"{v}_count")) for v in (POSITIVE, NEGATIVE, NEUTRAL)},
            **{c: F.coalesce(c, F.lit(0.0)) for c in ("avg_confidence", "min_confidence", "max_confidence")},
        }
    )


def theme_sentences(document: DataFrame) -> DataFrame:
    """One row per sentence of a themes document (or of exported contribution lines)."""
    if "themes" in document.columns:
        document = document.select(F.explode("themes").alias("t")).select("t.*")
    contributions = document.select("theme_id", "theme_name", F.explode("firm_contributions").alias("c"))
    return contributions.select(
        "theme_id", "theme_name",
        "c.firm_id", "c.firm_name", "c.permno", "c.cluster_id", "c.earnings_call_date",
        F.explode("c.sentences").alias("s"),
    ).select("*", "s.*").drop("s")


def firm_details(labelled: DataFrame) -> DataFrame:
    """Per-firm counts, shares and mean confidence inside each theme."""
    keys = ["theme_id", "firm_id", "firm_name", "cluster_id"]
    return distribution(labelled, keys).withColumnRenamed("total_count", "n_sentences")


def theme_events(labelled: DataFrame, permnos: DataFrame | None = None) -> DataFrame:
    """One event per theme and firm: score rounded to 4 digits on the call date.

    The permno comes from the contribution, else from `permnos(firm_id, mapped)`. The date is
    the call date, else the first transcript date. Events without permno or readable date carry
    a reason in `rejected` instead of being lost.
    """
    # a string minimum costs a sort-based aggregate, so it is taken only where dates are given
    fallback = [F.min("transcript_date").alias("_first_date")] if "transcript_date" in labelled.columns else []
    scored = labelled.groupBy(*GROUP).agg(*label_counts(), F.count(F.lit(1)).alias("n_sentences"), *fallback)
    call_date = F.coalesce("earnings_call_date", "_first_date") if fallback else F.col("earnings_call_date")
    if permnos is not None:
        scored = scored.join(permnos.select("firm_id", "mapped"), "firm_id", "left").withColumn(
            "permno", F.coalesce("permno", "mapped")
        )
    score = F.try_divide((F.col("positive_count") - F.col("negative_count")).cast("double"), F.col("total_count"))
    day = dates.parse_date(call_date)
    reason = F.when(F.col("permno").isNull(), "no permno").when(day.isNull(), "no readable date")
    return scored.select(
        "permno", day.alias("edate"), F.round(F.coalesce(score, F.lit(0.0)), 4).alias("sentiment"),
        "theme_id", "theme_name", "firm_id", "firm_name", "n_sentences", reason.alias("rejected"),
    )


def accepted(events: DataFrame) -> DataFrame:
    return events.filter(F.col("rejected").isNull()).drop("rejected")


def with_themes(events: DataFrame) -> DataFrame:
    """Events without theme columns form the single theme `all`; a theme goes by its id and carries the first of its names."""
    if {"theme_id", "theme_name"} <= set(events.columns):
        names = events.groupBy(F.col("theme_id").alias("_id")).agg(F.min("theme_name").alias("_name"))
        named = events.join(names, F.col("theme_id").eqNullSafe(F.col("_id")))
        return named.withColumn("theme_name", F.col("_name")).select(*events.columns)
    return events.drop("theme_id", "theme_name").withColumns(
        {"theme_id": F.lit("all"), "theme_name": F.lit("all_themes")}
    )


def study_events(events: DataFrame) -> DataFrame:
    """Distinct (permno, edate) of all themes, studied once with neutral sentiment."""
    return events.select("permno", "edate").distinct().withColumn("sentiment", F.lit(0))


def theme_results(results: DataFrame, events: DataFrame) -> DataFrame:
    """Study results of each theme's events with the theme's own sentiment."""
    own = events.select("theme_id", "theme_name", "permno", "edate", "sentiment")
    return results.drop("sentiment", "theme_id", "theme_name").join(own, ["permno", "edate"])
