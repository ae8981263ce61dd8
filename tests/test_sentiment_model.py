from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from callweave.catalog import market_queries
from callweave.plans import sentiment

FOLDER = "/root/testdata/sf0.01"
POSITIVE = ["growth", "improved", "increase", "record", "strong"]
NEGATIVE = ["challenge", "decline", "decrease", "loss", "weak"]


def test_held_out_accuracy_beats_the_lists(spark):
    rows = market_queries.quality_examples(spark, FOLDER)
    model = sentiment.word_model(rows.filter("fold > 0"))
    held = rows.filter("fold = 0").withColumnRenamed("label", "true")
    share = lambda found: found.select(F.avg((F.col("label") == F.col("true")).cast("int"))).first()[0]
    learned = share(sentiment.learned(held, model))
    listed = share(held.withColumn("label", sentiment.lexicon_label(F.col("text"), POSITIVE, NEGATIVE)[0]))
    most = held.groupBy("true").count().agg(F.max("count") / F.sum("count")).first()[0]
    print("learned", learned, "listed", listed, "most frequent", most)
    assert learned > 0.85 and learned > most > listed


def test_three_labels_nulls_and_columns(spark):
    good, bad, dull = "profits grew nicely", "losses widened badly", "the meeting is on monday"
    rows = [(good, "positive"), (bad, "negative"), (dull, "neutral"), ("unknown", None)] * 5
    model = sentiment.word_model(spark.createDataFrame(rows, "text string, label string"))
    asked = spark.createDataFrame([(1, good, "x"), (2, bad, "x"), (3, dull, "x"), (4, None, "x"), (5, "", "x")], "id int, text string, kept string")
    got = sentiment.learned(asked, model)
    assert got.columns == ["id", "text", "kept", "label", "score"]
    found = {r.id: r for r in got.collect()}
    assert [found[i].label for i in (1, 2, 3)] == ["positive", "negative", "neutral"]
    assert found[4].score == found[5].score == pytest.approx(1 / 3, abs=1e-3) and found[1].score > 0.5


def test_texts_are_split_once(spark):
    """The n-grams name the tokens several times; each copy in the plan would split the text again."""
    rows = spark.createDataFrame([("a b c",)], "text string")
    plan = sentiment._featured(rows, 16, "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
