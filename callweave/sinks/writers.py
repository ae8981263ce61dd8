"""Result files. Large results stay folders of part files; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions import dates, text
from callweave.functions.fixed import STORED_KEYWORDS
from callweave.plans import regression


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def by_theme_csv(df: DataFrame, path: str, stem: str, limit: int | None = None) -> None:
    """CSV split into one folder per theme, named by theme id and cleaned theme name."""
    name = F.concat_ws("_", "theme_id", F.trim(text.safe_name(F.col("theme_name"), limit, " -")), F.lit(stem))
    day = {c: dates.us_date(F.col(c)) for c, t in df.dtypes if c == "edate" and t == "date"}
    df.withColumns({"file": name, **day}).write.mode("overwrite").partitionBy("file").option("header", True).csv(path)


def lines(df: DataFrame, path: str, order: list[str]) -> None:
    """Text lines in order: sorted by range, so part files follow each other."""
    df.orderBy(*order).select("line").write.mode("overwrite").text(path)


def significance(summary: DataFrame, path: str) -> None:
    csv(summary, f"{path}/regression_significance_summary_csv")
    lines(regression.summary_report(summary), f"{path}/regression_significance_summary_txt", ["section", "rank", "part"])


def study(frames: dict[str, DataFrame], output: str, path: str | None = None):
    """Event study results as frames, printed, JSON or CSV; any other format gives None."""
    if output == "df":
        return frames
    if output == "print":
        for name, df in frames.items():
            print(name)
            print("\t".join(df.columns))
            for row in df.toLocalIterator():  # all rows, a partition at a time
                print("\t".join(map(str, row)))
        return None
    if output in ("json", "csv"):
        if path is None:
            raise ValueError(f"{output} output needs a path")
        for name, df in frames.items():
            writer = df.write.mode("overwrite")
            writer.json(f"{path}/{name}") if output == "json" else writer.option("header", True).csv(f"{path}/{name}")
        return path
    if output in ("xls", "xlsx"):
        raise NotImplementedError("no spreadsheet writer is available; use csv")
    return None


def key_value_sentences(sentences: DataFrame) -> DataFrame:
    """Items keyed by topic and indexed by firm."""
    return sentences.select(
        F.concat_ws("#", F.lit("TOPIC"), "firm_id", "topic_id").alias("pk"),
        F.concat_ws("#", F.lit("SENTENCE"), "sentence_id").alias("sk"),
        F.concat_ws("#", F.lit("FIRM"), "firm_id").alias("firm_key"),
        F.col("raw_text").alias("text"),
    )


def key_value_themes(themes: DataFrame, topics: DataFrame) -> DataFrame:
    """Theme items and topic links in one item set; keywords capped at twenty."""
    pk = F.concat_ws("#", F.lit("THEME"), "theme_id").alias("pk")
    meta = themes.select(
        pk, F.lit("METADATA").alias("sk"), "name",
        F.slice("keywords", 1, STORED_KEYWORDS).alias("keywords"), "n_firms", "n_topics",
    )
    links = topics.select(
        pk, F.concat_ws("#", F.lit("TOPIC"), "firm_id", "topic_id").alias("sk"), "representation", "size"
    )
    return meta.unionByName(links, allowMissingColumns=True)
