"""Exact duplicates by a tree merge of sorted digest runs.

Rows are dealt to runs. Inside a run equal digests are sorted together and merged to one entry that
keeps the best identifier and the number of copies. Then the runs meet in rounds: `fan_in` of them
are merged into one, entry by entry, until a single run is left. An entry is far smaller than its
text, a round never sees a text, and because each round is a grouped merge on (run, digest), the
last run too is spread over all tasks.

Entries merge only when the SHA-256, a second hash and the length of the bare text all agree, at
every level.

Null texts count as empty. Rows that repeat, with the same identifier too, are told apart by a stored
row number, so exactly one row of a group stays. A null identifier sorts after all others.
Empty tables give empty results; further columns pass through `deduplicate` untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.shared import SPACES, free_name, table, with_row_ids
from callweave.session import materialize

RUNS = 16
FAN_IN = 4
KEY = ["digest", "bare_chars", "check"]


def digests(docs: DataFrame, row: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow entry per row: digest and checks of the text without white space, rank values."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    bare = F.regexp_replace(whole, SPACES, "")
    return docs.select(
        F.col(row).alias("row"), F.col(doc_id).alias("doc_id"), F.length(whole).cast("long").alias("n_chars"), bare.alias("bare")
    ).select(
        "row", "doc_id", "n_chars",
        F.unhex(F.sha2("bare", 256)).alias("digest"),
        F.length("bare").alias("bare_chars"),
        F.xxhash64("bare").alias("check"),
    )


def merge_runs(entries: DataFrame, runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """One entry per digest: the row that stays and the size of its group."""
    rank = F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    level = (
        entries.select((F.shiftright("row", 33) % runs).alias("run"), *KEY, rank.alias("best"))
        .groupBy("run", *KEY)
        .agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("group_size"))
    )
    while runs > 1:
        runs = -(-runs // fan_in)
        level = (
            level.withColumn("run", F.floor(F.col("run") / fan_in))
            .groupBy("run", *KEY)
            .agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
        )
    return level.select(*KEY, F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """Every row with its group: doc_id, keep_id, group_size, kept and the digest of its bare text."""
    row = free_name(docs.columns, "row")
    entries = _stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), row)
    return _grouped(entries, merge_runs(entries, runs, fan_in))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """`docs` without the rows whose text, white space aside, a better row also has."""
    row = free_name(docs.columns, "row")
    placed = with_row_ids(docs, row)
    entries = materialize(digests(placed, row, doc_id, text))
    # the few rows that go are looked up, so that texts are not shuffled for those that stay
    gone = materialize(_grouped(entries, merge_runs(entries, runs, fan_in), "row").filter(~F.col("kept")).select(F.col("row").alias(row)))
    return placed.join(gone, row, "left_anti").select(*docs.columns)


def _stored(docs: DataFrame, row: str) -> DataFrame:
    return materialize(digests(docs.withColumn(row, F.monotonically_increasing_id()), row))


def _grouped(entries: DataFrame, merged: DataFrame, *more: str) -> DataFrame:
    return entries.join(merged, KEY).select(
        *more, "doc_id", "keep_id", "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op8_exact_dedup(spark, folder: str) -> DataFrame:
    return groups(table(spark, folder, "documents"))


ORACLE = """
    WITH d AS (
        SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS bare
        FROM documents)
    SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
           row_number() OVER best = 1 AS kept, sha256(bare) AS text_sha256
    FROM d WINDOW best AS (PARTITION BY bare ORDER BY n DESC, doc_id NULLS LAST)
"""
