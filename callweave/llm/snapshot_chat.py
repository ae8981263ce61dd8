"""Chat formatting with collapse of cumulative snapshots.

A logged conversation is often a snapshot that a longer log contains as its first turns. Turns are put in order, every
prefix of a conversation gets a rolling 128-bit hash (the exclusive or of the hashes of its turns, each salted with
its place), and a conversation whose whole hash is the hash of a shorter part of another one is left out by an anti join. Of equal
conversations the least identifier stays. The maximal ones are rendered.

The order is turn (null first), role, hash of the text; a turn logged twice with the same turn number, role and text is one.
Turns are sorted by ranges and carried over, and texts are rendered in parts of `part_turns` turns, so a conversation of any length is never
gathered in one task; the parts in order are the conversation. Turn marks inside a text are broken up, so a text cannot forge a
turn. Null roles are `unknown`, null texts empty. Turns without a conversation identifier belong to none and are left out. Empty
tables give empty results; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.shared import table
from callweave.session import materialize

PART_TURNS = 500
OPEN, BROKEN, END = "<|", "< |", "<|end|>\n"
HASH = ["n", "x", "y"]


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, row, role, n, x, y): place in the conversation and the hash of the turns up to it.

    `turns` has conv_id, turn, role, digest and row.
    """
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    placed = materialize(turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("at", 33))
    inside = Window.partitionBy("conv_id", "part").orderBy("at")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)

    counted = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("m"))
    carried = counted.select("conv_id", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before_n"))
    local = placed.withColumn("n", F.row_number().over(inside))
    salted = materialize(
        local.join(carried, ["conv_id", "part"])
        .withColumn("n", F.col("n") + F.col("before_n"))
        .withColumns({c: F.xxhash64(F.lit(c), "n", "role", "digest") for c in "xy"})
        .select("conv_id", "part", "at", "row", "n", "x", "y")
    )
    totals = salted.groupBy("conv_id", "part").agg(F.bit_xor("x").alias("tx"), F.bit_xor("y").alias("ty"))
    carried = totals.select("conv_id", "part", *[F.coalesce(F.bit_xor(f"t{c}").over(before), F.lit(0)).alias(f"before_{c}") for c in "xy"])
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = salted.withColumns({c: F.bit_xor(c).over(upto) for c in "xy"}).join(carried, ["conv_id", "part"])
    return rolled.select("conv_id", "row", "n", *[F.col(c).bitwiseXOR(F.col(f"before_{c}")).alias(c) for c in "xy"])


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that no longer one begins with."""
    last = prefixes.groupBy("conv_id").agg(F.max(F.struct(*HASH)).alias("whole"))
    wholes = last.groupBy("whole").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    lengths = last.select("conv_id", F.col("whole.n").alias("length"))
    proper = prefixes.join(lengths, "conv_id").filter("n < length").select(*HASH).distinct()
    kept = wholes.select("conv_id", "n_copies", "whole.*").join(proper, HASH, "left_anti")
    return kept.select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def rendered(role: Column, text: Column) -> Column:
    def safe(value: Column) -> Column:
        return F.replace(value, F.lit(OPEN), F.lit(BROKEN))

    return F.concat(F.lit(OPEN), safe(role), F.lit("|>\n"), safe(text), F.lit(END))


def collapse(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_turns: int = PART_TURNS
) -> DataFrame:
    """conv_id, part, n_turns, n_copies and the rendered text of each part of each maximal conversation."""
    logged = materialize(
        conversations.filter(F.col(conv_id).isNotNull())
        .select(
            F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("role"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        )
        .withColumn("row", F.monotonically_increasing_id())
    )
    narrow = logged.select("conv_id", "turn", "role", "row", F.md5(F.col("text").cast("binary")).alias("digest"))
    once = narrow.groupBy("conv_id", "turn", "role", "digest").agg(F.min("row").alias("row"))
    prefixes = materialize(numbered(once))
    chosen = prefixes.select("conv_id", "row", "n").join(maximal(prefixes), "conv_id")
    texts = chosen.join(logged.select("row", rendered(F.col("role"), F.col("text")).alias("said")), "row")
    return (
        texts.groupBy("conv_id", F.floor((F.col("n") - 1) / part_turns).alias("part"), "n_turns", "n_copies")
        .agg(F.array_sort(F.collect_list(F.struct("n", "said"))).alias("turns"))
        .select("conv_id", "part", "n_turns", "n_copies", F.array_join(F.col("turns.said"), "").alias("text"))
    )


def op2_snapshot_chat(spark, folder: str) -> DataFrame:
    return collapse(table(spark, folder, "conversations"))


ORACLE = f"""
    WITH t AS (
        SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS n FROM t),
    c AS (SELECT conv_id, list(role || chr(1) || text ORDER BY n) AS l FROM o GROUP BY conv_id),
    proper AS (SELECT DISTINCT l[1:k] AS p FROM (SELECT l, unnest(range(1, len(l))) AS k FROM c)),
    w AS (SELECT l, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY l),
    m AS (SELECT conv_id, CAST(len(l) AS BIGINT) AS n_turns, n_copies FROM w WHERE NOT EXISTS (SELECT 1 FROM proper WHERE p = w.l))
    SELECT conv_id, (n - 1) // {PART_TURNS} AS part, n_turns, n_copies,
           string_agg('<|' || replace(role, '<|', '< |') || chr(124) || '>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10), ''
                      ORDER BY n) AS text
    FROM o JOIN m USING (conv_id) GROUP BY ALL
"""
