"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet to the shared folder and hands the
reread table to the next stage. All stages but the last return the columns of their input.

Null and empty texts, and texts without a letter, end at the language stage. Repeated rows end at the exact one. An empty
table passes all stages and gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import byte_bpe, exact_dedup, langid, mixing, shingle_dedup
from callweave.llm.shared import free_name, spread, table
from callweave.session import drop_tables, materialize, tables

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_held: dict[str, list[str]] = {}  # intermediate tables of the last stage, by folder


def _scoped(stage: Stage) -> Stage:
    """The stage, but the tables that the one before it used are deleted first, as its output has been written by then.

    Tables that `docs` still reads stay.
    """

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if before := _held.pop(sf_dir, []):
            read = docs.inputFiles()
            drop_tables(spark, [path for path in before if not any(path.split("/")[-1] in f for f in read)])
        with tables() as made:
            out = stage(spark, docs, sf_dir)
        _held[sf_dir] = made
        return out

    return begun


@_scoped
def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach."""
    lang, score = (free_name(docs.columns, n) for n in ("lang_pred", "lang_score"))
    marked = langid.predict(spread(docs), langid.fit(docs), lang, score)
    return marked.filter(F.col(lang) != langid.UNKNOWN).select(*docs.columns)


@_scoped
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space."""
    return exact_dedup.deduplicate(docs)


@_scoped
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash fingerprints or by five-word shingles in common, at 0.8 or more of all."""
    return shingle_dedup.deduplicate(docs)


@_scoped
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target share of its source asks."""
    return mixing.mix(docs)


@_scoped
def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text, and the digest of the text that they decode to."""
    ids, digest, count = (free_name(docs.columns, n) for n in ("ids", "decoded_sha256", "n_tokens"))
    return byte_bpe.encode(spread(docs), out=ids, decoded_sha256=digest).withColumn(count, F.size(ids).cast("long"))


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identified),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("mixing sources", mixed),
    ("byte BPE", tokenized),
]

# language ID, near-duplicate fingerprints and token ids cannot be expressed in SQL
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to `documents`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
