"""Mixing sources to target shares by repetition rates.

Words are summed per source, targets follow from the weights, and a source's rate is its target over
its size. A document is emitted floor(rate) times, and once more if a hash of its identifier
falls below the fraction of the rate. Several hash seeds are summed per source in the same pass, and the
source takes the one whose total comes nearest its target, so that a few long documents do not
carry a small source away from it. A rerun gives the same mix.

Targets: the sources, by code point with null last, take weights 1, 2, 3, 1, ... of all words. A
target stops at `cap` times its source's size, and what is cut off is shared again by weight among the
others. That fixed point is a water level: target = min(cap * size, level * weight), where the level
is found from running sums over the sources in the order of cap * size / weight.

The per-source table has a row for each source only. Null texts have size 0, and a source of size 0 has target
and rate 0. A null identifier hashes as the empty text; equal rows fare alike. Further
columns pass through `mix` untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.shared import WORD, free_name, table
from callweave.session import materialize

WEIGHTS = (1, 2, 3)
CAP = 3
DIGESTS = 4
PER_DIGEST = 4
HEX = 8


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """Uniform number in [0, 1) from eight hex digits of an MD5; four seeds share a digest."""
    digest = F.md5(F.concat(F.lit(f"mix{seed // PER_DIGEST}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    part = F.substring(digest, 1 + HEX * (seed % PER_DIGEST), HEX)
    return F.conv(part, 16, 10).cast("double") / float(16**HEX)


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Identifier, source and number of words of every document; the texts are read this once."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"))


def targets(per_source: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target from one row per source with its `source_size`."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    top = (cap * F.col("source_size")).cast("double")
    bounded = per_source.withColumn("weight", weight).withColumn("top", top).withColumn("bound", F.col("top") / F.col("weight"))
    filled = Window.orderBy("bound", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("top").over(filled), F.lit(0.0))
    free = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))
    level = F.max("level").over(everything)
    return (
        bounded.withColumn("level", left / free)
        .withColumn("target", F.least("top", level * F.col("weight")))
        .select("source", "source_size", "target")
    )


def rates(sized: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source: its size and target, whole copies, fraction and the seed of the draw."""
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = materialize(
        targets(per_source, weights, cap)
        .withColumn("rate", rate)
        .withColumn("whole", F.floor("rate"))
        .withColumn("fraction", F.col("rate") - F.col("whole"))
        .drop("rate")
    )
    seeds = range(DIGESTS * PER_DIGEST)
    extra = [F.sum(F.when(draw(F.col("doc_id"), s) < F.col("fraction"), F.col("size")).otherwise(F.lit(0))).alias(f"x{s}") for s in seeds]
    tried = with_goal(sized, goals).groupBy("source").agg(*extra).withColumnRenamed("source", "tried")
    want = F.col("target") - F.col("whole") * F.col("source_size")
    best = F.least(*[F.struct(F.abs(F.col(f"x{s}") - want).alias("off"), F.lit(s).alias("seed")) for s in seeds])
    return goals.join(tried, F.col("source").eqNullSafe(F.col("tried"))).select(*goals.columns, best["seed"].alias("seed"))


def with_goal(docs: DataFrame, goals: DataFrame, source: str = "source") -> DataFrame:
    """The per-source row beside each document; Spark weighs the size of `goals` itself."""
    side = goals.withColumnRenamed("source", "_goal_source")
    return docs.join(side, F.col(source).eqNullSafe(F.col("_goal_source"))).drop("_goal_source")


def copies(doc_id: Column) -> Column:
    """Times a document is emitted, where the columns of `rates` stand beside it."""
    seeds = F.array(*[draw(doc_id, s) for s in range(DIGESTS * PER_DIGEST)])
    return F.col("whole") + (F.element_at(seeds, F.col("seed") + 1) < F.col("fraction")).cast("long")


def taken(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per document its size, its source's size and target, and the words the mix takes of it."""
    sized = materialize(sizes(docs, doc_id, text, source))
    return with_goal(sized, rates(sized)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("doc_id"))).alias("taken")
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed documents: rows of `docs`, each as often as its source's rate asks."""
    chosen = materialize(rates(materialize(sizes(docs, doc_id, text, source))))
    times = free_name(docs.columns, "_times")
    clear = docs.select(*[F.col(c).alias(f"d_{c}") for c in docs.columns])
    dealt = with_goal(clear, chosen, f"d_{source}").withColumn(times, copies(F.col(f"d_{doc_id}")))
    repeated = dealt.filter(F.col(times) > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    return repeated.select(*[F.col(f"d_{c}").alias(c) for c in docs.columns])


def op7_mix_sources(spark, folder: str) -> DataFrame:
    return taken(table(spark, folder, "documents"))


def _sql_draw(seed: int) -> str:
    part = f"substr(md5('mix{seed // PER_DIGEST}:' || coalesce(CAST(doc_id AS VARCHAR), '')), {1 + HEX * (seed % PER_DIGEST)}, {HEX})"
    return f"CAST(('0x' || {part}) AS BIGINT) / {float(16**HEX)}"


_SEEDS = range(DIGESTS * PER_DIGEST)
ORACLE = f"""
    WITH sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
    per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
    weighed AS (
        SELECT *, CAST([1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS DOUBLE) AS weight,
               CAST(3 * source_size AS DOUBLE) AS top FROM per),
    levels AS (
        SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(top) OVER filled, 0))
                  / (sum(weight) OVER () - coalesce(sum(weight) OVER filled, 0)) AS lvl
        FROM weighed
        WINDOW filled AS (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    goals AS (
        SELECT source, source_size, target, floor(rate) AS whole, rate - floor(rate) AS fraction
        FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate
              FROM (SELECT *, least(top, max(lvl) OVER () * weight) AS target FROM levels))),
    drawn AS (
        SELECT s.doc_id, s.size, g.*, [{', '.join(_sql_draw(s) for s in _SEEDS)}] AS u
        FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
    tried AS (
        SELECT source, [{', '.join(f'abs(sum(CASE WHEN u[{s + 1}] < fraction THEN size ELSE 0 END) - (any_value(target) - any_value(whole) * any_value(source_size)))' for s in _SEEDS)}] AS off
        FROM drawn GROUP BY source)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
           CAST(size * (whole + CASE WHEN u[list_position(off, list_min(off))] < fraction THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM drawn d JOIN tried t ON d.source IS NOT DISTINCT FROM t.source
"""
