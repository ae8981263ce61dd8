"""The given tables under the engine's names: which column plays which part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.session import widen


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose rows need heavy text work."""
    return widen(table(spark, folder, name))


def components(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as transcript components of seven firms; `system` plays the operator."""
    return texts(spark, folder, "conversations").select(
        (F.col("conv_id") % 7).cast("string").alias("companyid"),
        F.concat(F.lit("Firm "), (F.col("conv_id") % 7).cast("string")).alias("companyname"),
        F.col("conv_id").cast("string").alias("transcriptid"),
        F.col("turn").cast("int").alias("componentorder"),
        F.col("role").alias("speakertypename"),
        F.col("text").alias("componenttext"),
    )


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """Events as one return row per user and day."""
    return (
        table(spark, folder, "events")
        .groupBy(F.col("user_id").alias("permno"), F.to_date("ts").alias("date"))
        .agg(
            (F.avg("value") / 1000).alias("ret"),
            F.sum("value").alias("prc"),
            F.count(F.lit(1)).cast("double").alias("shrout"),
        )
    )


def calendar(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.to_date("ts").alias("date")).distinct()


def factors(series: DataFrame) -> DataFrame:
    """Daily factors from the cross-section of users."""
    few = F.col("shrout") <= 2
    return series.groupBy("date").agg(
        F.avg("ret").alias("mktrf"),
        F.lit(0.0001).alias("rf"),
        (F.avg(F.when(few, F.col("ret"))) - F.avg("ret")).alias("smb"),
        F.stddev_samp("ret").alias("hml"),
        (F.sum(F.col("ret") * F.col("shrout")) / F.sum("shrout") - F.avg("ret")).alias("umd"),
    )


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Events as classified sentences: four themes by the `k` property, users as firms."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.format_string("theme_%03d", F.floor(k / 25)).alias("theme_id"),
        F.concat(F.lit("Theme "), F.floor(k / 25).cast("string")).alias("theme_name"),
        F.col("user_id").cast("string").alias("firm_id"),
        F.concat(F.lit("Firm "), F.col("user_id").cast("string")).alias("firm_name"),
        F.col("user_id").alias("permno"),
        F.date_format("ts", "yyyy-MM-dd").alias("earnings_call_date"),
        F.when(kind == "purchase", "positive").when(kind == "error", "negative").otherwise("neutral").alias("label"),
        (F.col("value") / 500).alias("score"),
    )


# the same parts as SQL, shared by the reference queries
SQL = {
    "daily": """daily AS (
        SELECT user_id AS permno, CAST(ts AS DATE) AS date, avg(value) / 1000 AS ret, sum(value) AS prc,
               CAST(count(*) AS DOUBLE) AS shrout
        FROM events GROUP BY 1, 2)""",
    "days": """days AS (
        SELECT date, row_number() OVER (ORDER BY date) AS td FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events))""",
    "factors": """factors AS (
        SELECT date, avg(ret) AS mktrf, 0.0001 AS rf, avg(ret) FILTER (shrout <= 2) - avg(ret) AS smb,
               stddev_samp(ret) AS hml, sum(ret * shrout) / sum(shrout) - avg(ret) AS umd
        FROM daily GROUP BY date)""",
    "labelled": """labelled AS (
        SELECT printf('theme_%03d', k // 25) AS theme_id, 'Theme ' || (k // 25) AS theme_name,
               CAST(user_id AS VARCHAR) AS firm_id, 'Firm ' || user_id AS firm_name, user_id AS permno, day AS edate,
               CASE event_type WHEN 'purchase' THEN 'positive' WHEN 'error' THEN 'negative' ELSE 'neutral' END AS label,
               value / 500 AS score
        FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k, CAST(ts AS DATE) AS "day" FROM events))""",
    "scored": """scored AS (
        SELECT theme_id, theme_name, firm_id, firm_name, permno, edate, count(*) AS n_sentences,
               round(CAST(count(*) FILTER (label = 'positive') - count(*) FILTER (label = 'negative') AS DOUBLE)
                     / count(*), 4) AS sentiment
        FROM labelled GROUP BY ALL)""",
}


def sql(*names: str) -> str:
    return ", ".join(SQL[n] for n in names)
