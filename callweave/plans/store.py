"""The stored hierarchy theme > topic > sentence with firms, as Parquet tables.

A run writes batches of firms. Each batch is one partition, overwritten as a whole, and a firm
counts as processed only once its marker row is written last, so a lost run can be repeated
without leaving duplicates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave import schemas
from callweave.functions import text, vectors
from callweave.operators import relational, scan, stabbing


def key(*parts: str | Column) -> Column:
    """Stable id from a natural key."""
    return F.xxhash64(*parts)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, table: str) -> str:
        return f"{self.path}/{table}"

    def create(self) -> None:
        """Write empty tables where none exist."""
        for table, schema in schemas.STORE.items():
            if not self._exists(table):
                self.spark.createDataFrame([], schema).write.parquet(self._at(table))

    def _exists(self, table: str) -> bool:
        try:
            self.spark.read.parquet(self._at(table))
            return True
        except AnalysisException:
            return False

    def table(self, name: str) -> DataFrame:
        schema = schemas.STORE[name]
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        stored = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.StringType())]))
        return stored.parquet(self._at(name)).select(*schema.names)

    def batched(self, name: str) -> DataFrame:
        """A table with the batch of each row."""
        schema = T.StructType([*schemas.STORE[name].fields, T.StructField("batch", T.StringType())])
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._at(name))

    def replace_batches(self, name: str, rows: DataFrame) -> None:
        """Replace the batches that `rows`, which must not read from the table any more, name in `batch`."""
        shaped = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.STORE[name].fields], "batch")
        writer = shaped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("batch").parquet(self._at(name))

    def write(self, name: str, rows: DataFrame, batch: str) -> None:
        """Replace one batch of a table; other batches stay. Without rows the batch is emptied too."""
        shaped = rows.select(
            *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.STORE[name].fields],
            F.lit(batch).alias("batch"),
        )
        if shaped.isEmpty():
            self._forget(name, batch)
            return
        (
            shaped.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(self._at(name))
        )

    def _forget(self, name: str, batch: str) -> None:
        """Drop the files of one batch; a dynamic overwrite leaves a partition that gets no rows."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(name), f"batch={batch}")
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.delete(place, True)

    def write_firms(
        self, batch: str, firms: DataFrame, topics: DataFrame, sentences: DataFrame, entities: DataFrame | None = None
    ) -> None:
        """Topics, then sentences carrying their topic id, then entities, then the markers.

        Inputs carry `company_id`; ids are hashes of natural keys, so no row is written twice.
        """
        firm = key("company_id")
        self.write("firms", firms.withColumns({"id": firm, "processed_at": F.current_timestamp()}), batch)
        topic = key("company_id", "local_topic_id")
        self.write("topics", topics.withColumns({"firm_id": firm, "id": topic}), batch)
        placed = F.when(F.col("local_topic_id") >= 0, topic)
        self.write(
            "sentences",
            sentences.withColumns({"firm_id": firm, "id": key("company_id", "sentence_id"), "topic_id": placed}),
            batch,
        )
        if entities is not None:
            self.write(
                "extracted_entities",
                entities.withColumns(
                    {
                        "sentence_id": key("company_id", "sentence_id"),
                        "id": key("company_id", "sentence_id", "entity_type", "value"),
                    }
                ),
                batch,
            )
        marks = firms.select("company_id", F.lit(batch).alias("batch_id"), F.current_timestamp().alias("processed_at"))
        self.write("processed_firms", marks, batch)

    def write_themes(self, themes: DataFrame, topic_themes: DataFrame) -> None:
        """Replace all themes and the topic links."""
        self.replace("themes", themes)
        self.replace("topic_themes", topic_themes)

    def replace(self, name: str, rows: DataFrame) -> None:
        """Replace a whole table; `rows` must not read from it any more."""
        shaped = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.STORE[name].fields])
        writer = shaped.withColumn("batch", F.lit("all")).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "static").partitionBy("batch").parquet(self._at(name))

    def add_firms(self, incoming: DataFrame, batch: str) -> None:
        """Insert the firms that are not stored yet."""
        order = [F.col("processed_at").desc_nulls_last(), F.col("name")]
        fresh = relational.upsert_new(self.table("firms"), incoming, ["company_id"], order)
        self.write("firms", fresh.withColumn("id", key("company_id")), batch)

    def drop(self, names: Sequence[str] = tuple(schemas.STORE)) -> None:
        """Empty the named tables (an overwrite with no rows)."""
        for name in names:
            empty = self.spark.createDataFrame([], schemas.STORE[name])
            empty.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(self._at(name))

    def firm(self, company_id: str) -> DataFrame:
        return self.table("firms").filter(F.col("company_id") == company_id)

    def sentences_of(self, firm_id: int | None = None, topic_id: int | None = None) -> DataFrame:
        """Sentences of a firm or a topic by position."""
        rows = self.table("sentences")
        rows = rows if firm_id is None else rows.filter(F.col("firm_id") == firm_id)
        rows = rows if topic_id is None else rows.filter(F.col("topic_id") == topic_id)
        return in_order(rows)

    def sentences_by_speaker(self, speaker: str) -> DataFrame:
        return by_speaker(self.table("sentences"), speaker)

    def topics_of(self, firm_id: int | None = None, theme_id: int | None = None) -> DataFrame:
        """Topics of a firm or a theme by their local number."""
        rows = self.themed_topics()
        rows = rows if firm_id is None else rows.filter(F.col("firm_id") == firm_id)
        rows = rows if theme_id is None else rows.filter(F.col("theme_id") == theme_id)
        return rows.orderBy("local_topic_id", "id")

    def firms_by_state(self, processed: bool) -> DataFrame:
        return in_state(self.table("firms"), processed)

    def unprocessed(self, available: DataFrame) -> DataFrame:
        """Available firm ids without a marker, in order."""
        done = self.table("processed_firms").select("company_id")
        return available.join(done, "company_id", "left_anti").orderBy("company_id")

    def finished(self, batch: str) -> bool:
        """Whether the batch has its markers; writing it again would drop its firms."""
        return not self.table("processed_firms").filter(F.col("batch_id") == batch).isEmpty()

    def themed_topics(self) -> DataFrame:
        links = self.table("topic_themes").withColumnRenamed("topic_id", "id")
        return self.table("topics").join(links, "id", "left")


def hierarchy(themes: DataFrame, topics: DataFrame, sentences: DataFrame, firms: DataFrame) -> DataFrame:
    """Theme, topic, sentence and firm in one flat row each."""
    t = themes.select(F.col("id").alias("theme_id"), F.col("name").alias("theme_name"))
    p = topics.select(F.col("id").alias("topic_id"), "theme_id", "firm_id", "representation", "summary")
    s = sentences.select("topic_id", F.col("id").alias("sentence_id"), "raw_text", "speaker_type", "position")
    f = firms.select(
        F.col("id").alias("firm_id"), F.col("name").alias("firm_name"), "company_id", "ticker", "earnings_call_date"
    )
    return t.join(p, "theme_id").join(f, "firm_id").join(s, "topic_id")


def in_order(sentences: DataFrame) -> DataFrame:
    return sentences.orderBy("position", "id")


def by_speaker(sentences: DataFrame, speaker: str) -> DataFrame:
    """Sentences of one speaker type by position."""
    return in_order(sentences.filter(F.col("speaker_type") == speaker))


def in_state(firms: DataFrame, processed: bool) -> DataFrame:
    at = F.col("processed_at")
    return firms.filter(at.isNotNull() if processed else at.isNull())


def nested_topics(themes: DataFrame, topics: DataFrame, sentences: DataFrame, firms: DataFrame, part_rows: int = 10_000) -> DataFrame:
    """Themes with their topics and these with their sentences as lists by position.

    Themes without topics and topics without sentences stay, with an empty list; long topics continue in further parts.
    """
    t = themes.select(F.col("id").alias("theme_id"), F.col("name").alias("theme_name"))
    p = topics.select(F.col("id").alias("topic_id"), "theme_id", "firm_id", "representation")
    f = firms.select(F.col("id").alias("firm_id"), F.col("name").alias("firm_name"))
    named = sentences.select("topic_id", F.col("id").alias("sentence_id"), "raw_text", "speaker_type", "position")
    sentence = F.struct("sentence_id", "raw_text", "speaker_type", "position")
    placed = named.filter(F.col("topic_id").isNotNull())
    lists = scan.ordered_lists(placed, ["topic_id"], [F.col("position"), F.col("sentence_id")], sentence, "sentences", part_rows)
    whole = t.join(p, "theme_id", "left").join(f, "firm_id", "left").join(lists, "topic_id", "left")
    return whole.withColumns({"part": F.coalesce("part", F.lit(0)), "sentences": F.coalesce("sentences", F.array())})


def firm_summary(firms: DataFrame, topics: DataFrame, sentences: DataFrame, part_rows: int = 10_000) -> DataFrame:
    """Firm with its topic and sentence counts and its topics by id, 0 included; long lists continue in further parts."""
    counts = sentences.groupBy(F.col("topic_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    sized = topics.join(counts, "id", "left").withColumn("n_sentences", F.coalesce("n", F.lit(0)))
    totals = sized.groupBy("firm_id").agg(F.count(F.lit(1)).alias("n_topics"), F.sum("n_sentences").alias("n_sentences"))
    topic = F.struct("id", "representation", "n_sentences")
    lists = scan.ordered_lists(sized.filter(F.col("firm_id").isNotNull()), ["firm_id"], [F.col("id")], topic, "topics", part_rows)
    named = firms.select(F.col("id").alias("firm_id"), "name")
    zero = F.lit(0).cast("long")
    return named.join(totals, "firm_id", "left").join(lists, "firm_id", "left").withColumns(
        {"part": F.coalesce("part", zero), "n_topics": F.coalesce("n_topics", zero), "n_sentences": F.coalesce("n_sentences", zero),
         "topics": F.coalesce("topics", F.array())}
    )


def firm_themes(firms: DataFrame, topics: DataFrame, themes: DataFrame) -> DataFrame:
    """Distinct themes of every firm."""
    pairs = topics.select("firm_id", "theme_id").distinct()
    return (
        pairs.join(firms.select(F.col("id").alias("firm_id"), F.col("name").alias("firm_name")), "firm_id")
        .join(themes.select(F.col("id").alias("theme_id"), F.col("name").alias("theme_name")), "theme_id")
        .select("firm_name", "theme_name")
        .distinct()
    )


def coverage(sentences: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows, rows with a vector and the share in percent."""
    n = F.count(F.lit(1))
    return sentences.agg(
        n.alias("total"),
        F.count(vector).alias("with_vector"),
        F.round(F.try_divide(100.0 * F.count(vector), n), 2).alias("coverage_pct"),
    )


def topic_coverage(topics: DataFrame, sentences: DataFrame) -> DataFrame:
    """Sentence count and mean probability of each topic, 0 sentences included."""
    stats = sentences.groupBy(F.col("topic_id").alias("id")).agg(
        F.count(F.lit(1)).alias("_n"), F.round(F.avg("probability"), 3).alias("avg_probability")
    )
    return topics.join(stats, "id", "left").withColumn("sentence_count", F.coalesce("_n", F.lit(0))).drop("_n")


def similar(rows: DataFrame, query: Column, k: int, item: str = "id", vector: str = "embedding") -> DataFrame:
    """Exact nearest rows by cosine; each task keeps k rows."""
    scored = rows.withColumn("_q", query).withColumn("similarity", vectors.cosine(F.col(vector), F.col("_q"))).drop("_q")
    return scored.filter(F.col("similarity").isNotNull()).orderBy(F.desc("similarity"), item).limit(k)


def _valid_names(lookups: DataFrame, stocknames: DataFrame) -> DataFrame:
    """Distinct (ticker, date) with the PERMNO and start of the valid name record that began last."""
    asked = lookups.select(F.upper("ticker").alias("ticker"), "date")
    names = stocknames.select(F.upper("ticker").alias("ticker"), "permno", "namedt", "nameendt")
    return stabbing.latest_open(asked, names, "ticker", "date", "namedt", "nameendt", "permno")


def upper_ticker_permno(lookups: DataFrame, stocknames: DataFrame) -> DataFrame:
    """PERMNO of each (ticker, date): the valid name record that began last, NULL when none."""
    return _valid_names(lookups, stocknames).select("ticker", "date", "permno")


def ticker_permno(lookups: DataFrame, stocknames: DataFrame) -> DataFrame:
    """One PERMNO per ticker: the newest name record valid on any of the ticker's dates."""
    newest = F.max(F.struct("namedt", "permno")).alias("newest")
    found = _valid_names(lookups, stocknames).filter(F.col("namedt").isNotNull())
    return found.groupBy("ticker").agg(newest).select("ticker", F.col("newest.permno").alias("permno"))


def backfilled_dates(firms: DataFrame, fundq: DataFrame) -> DataFrame:
    """Missing call dates filled by (ticker, quarter); the latest report of duplicates wins."""
    reported = (
        fundq.filter(F.col("rdq").isNotNull())
        .groupBy(F.upper("tic").alias("_tic"), F.col("datacqtr").alias("_quarter"))
        .agg(F.max("rdq").alias("_rdq"))
    )
    keyed = firms.withColumns({"_t": F.upper("ticker"), "_q": text.quarter_key(F.col("quarter"))})
    joined = keyed.join(reported, (F.col("_t") == F.col("_tic")) & (F.col("_q") == F.col("_quarter")), "left")
    return joined.withColumn("earnings_call_date", F.coalesce("earnings_call_date", "_rdq")).select(*firms.columns)
