"""Transcript sources: local or object-store CSV, limited connectors and the sentence table."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave import schemas
from callweave.functions import nulls, text
from callweave.operators import relational
from callweave.session import widen


class Connector(Protocol):
    def fetch(self, firm_ids: Sequence[str] | None, start: str | None, end: str | None) -> DataFrame: ...
    def firm_ids(self) -> DataFrame: ...
    def close(self) -> None: ...


class TranscriptCsv:
    """Transcript components from CSV at any path Spark can read (local, s3a://, hdfs://).

    Quoted text may span lines. Optional columns that the files lack read as NULL. Reading is
    lazy; columns are matched by header name.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path
        self._named = self._read()

    def _read(self) -> DataFrame:
        options = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
        try:
            return self._spark.read.options(**options).csv(self._path)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                raise FileNotFoundError(self._path) from error
            raise

    def components(self) -> DataFrame:
        named = widen(self._named)
        wanted = {f.name: f.dataType.simpleString() for f in schemas.TRANSCRIPTS.fields}
        full = nulls.with_columns(named, **wanted)
        return full.select(*[F.col(n).try_cast(t).alias(n) for n, t in wanted.items()])

    def fetch(self, firm_ids: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        rows = self.components()
        if firm_ids is not None:
            rows = relational.in_list(rows, "companyid", [str(i) for i in firm_ids])
        if start is not None and end is not None:
            if "mostimportantdateutc" in (c.lower() for c in self._named.columns):
                rows = relational.between_dates(rows, F.col("mostimportantdateutc"), start, end)
        return relational.without_role(rows, "speakertypename", "operator")

    def firm_ids(self) -> DataFrame:
        return self.components().select("companyid").distinct().orderBy("companyid")

    def firm_id_by_name(self, name: str) -> str | None:
        hit = relational.by_name(self.components(), "companyname", name, ["companyid"]).first()
        return hit["companyid"] if hit else None

    def close(self) -> None:
        """Nothing is held open; kept for the connector protocol."""


class LimitedConnector:
    """Another connector seen through a fixed id list or its first n sorted ids."""

    def __init__(self, inner: Connector, ids: Sequence[str] | None = None, first: int | None = None):
        self._inner, self._ids, self._first = inner, ids, first

    def firm_ids(self) -> DataFrame:
        known = self._inner.firm_ids()
        if self._ids is not None:
            return relational.in_list(known, "companyid", [str(i) for i in self._ids])
        return relational.first_ids(known, "companyid", self._first)

    def fetch(self, firm_ids: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        return relational.keep_ids(self._inner.fetch(firm_ids, start, end), self.firm_ids(), "companyid")

    def close(self) -> None:
        self._inner.close()


def as_components(rows: DataFrame) -> DataFrame:
    """Component rows under the engine's names; NULL transcripts and blank texts are dropped."""
    kept = rows.filter(F.col("transcriptid").isNotNull() & (F.trim(F.coalesce("componenttext", F.lit(""))) != ""))
    return kept.select(
        F.col("companyid").alias("firm_id"),
        F.col("companyname").alias("firm_name"),
        text.whole_id(F.col("transcriptid")).alias("transcript_id"),
        F.col("componentorder").alias("component_order"),
        F.col("speakertypename").alias("speaker_type"),
        F.col("componenttext").alias("text"),
    )
