"""JSON and CSV documents exchanged between the stages."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave import schemas


def themes(spark: SparkSession, path: str) -> DataFrame:
    """Themes document in one JSON object."""
    return spark.read.schema(schemas.THEMES_DOCUMENT).json(path, multiLine=True)


def theme_rows(spark: SparkSession, path: str) -> DataFrame:
    """Theme rows from exported lines, the layout that scales."""
    element = schemas.THEMES_DOCUMENT["themes"].dataType.elementType
    return spark.read.schema(element).json(path)


def sentiment_scores(spark: SparkSession, path: str) -> DataFrame:
    """Sentiment CSV; the three required columns must be in the header."""
    named = spark.read.option("header", True).csv(path)
    absent = [c for c in schemas.SENTIMENT_REQUIRED if c not in named.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    types = {f.name: f.dataType for f in schemas.SENTIMENT.fields}
    return named.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in named.columns])


def firm_topics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Firm topic documents of a folder and the list of files that could not be used.

    One JSON object per file; files that do not parse or lack firm_id or topics are skipped.
    """
    read = (
        spark.read.schema(schemas.FIRM_TOPICS)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("pathGlobFilter", "*_topics.json")
        .json(path)
        .withColumn("file", F.col("_metadata.file_path"))
    )
    usable = F.col("_corrupt_record").isNull() & F.col("firm_id").isNotNull() & F.col("topics").isNotNull()
    return read.filter(usable).drop("_corrupt_record"), read.filter(~usable).select("file")


def list_json(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """Names and sizes of the JSON files below a path, on any file system Spark reads."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return listed.option("pathGlobFilter", f"*{suffix}").load(path).select("path", "length", "modificationTime")


@dataclass
class Config:
    """Run settings with the production defaults."""

    source: str = "data/transcripts.csv"
    start: str = "2023-01-01"
    end: str = "2023-03-31"
    store: str = "store"
    firm_ids: list[str] | None = None
    first_firms: int | None = None
    firm_model: dict = field(default_factory=dict)
    theme_model: dict = field(
        default_factory=lambda: {
            "umap": {"n_components": 15},
            "hdbscan": {"min_cluster_size": 20, "min_samples": 6, "cluster_selection_method": "eom"},
            "vectorizer": {"min_df": 3},
            "representation": {"mmr_diversity": 0.4},
        }
    )
    min_firms: int = 2
    max_dominance: float = 0.4

    @classmethod
    def load(cls, path: str | None = None, **over) -> Config:
        """Settings from YAML or JSON over the defaults; CALLWEAVE_* variables override settings of the file
        (plain text for texts, JSON for the others), and keyword arguments win."""
        given: dict = {}
        if path and Path(path).exists():
            body = Path(path).read_text()
            if path.endswith((".yaml", ".yml")):
                try:
                    import yaml
                except ImportError as error:
                    raise RuntimeError("reading YAML settings needs PyYAML; JSON always works") from error
                given = yaml.safe_load(body) or {}
            else:
                given = json.loads(body)
        texts = {f: os.environ[f"CALLWEAVE_{f.upper()}"] for f in cls.__dataclass_fields__ if f"CALLWEAVE_{f.upper()}" in os.environ}
        env = {f: v if cls.__dataclass_fields__[f].type == "str" else json.loads(v) for f, v in texts.items()}
        known = {k: v for k, v in {**given, **env, **over}.items() if k in cls.__dataclass_fields__ and v is not None}
        config = cls(**known)
        config.check()
        return config

    def check(self) -> None:
        if self.min_firms < 1:
            raise ValueError("min_firms must be at least 1")
        if not 0 < self.max_dominance <= 1:
            raise ValueError("max_dominance must be in (0, 1]")
        if self.start > self.end:
            raise ValueError("start must not be after end")
