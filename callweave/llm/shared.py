"""Small parts that several text operators share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.session import materialize

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_name(columns: Iterable[str], name: str) -> str:
    """`name` with as many underscores in front as it takes to clash with no column."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_row_ids(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder with a number per row, so that equal rows stay apart.

    The numbers are stored, hence the same for every later reader, also after executors are lost.
    """
    return materialize(df.withColumn(name, F.monotonically_increasing_id()))


def spread(scan: DataFrame) -> DataFrame:
    """Deal a scan of fewer splits than cores out to all cores, in rows' round-robin order.

    Rows keep their text, so this is one shuffle of the input, made only where the files are so
    few that most cores would have nothing to do.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
KEPT: dict[str, Callable[[], object]] = {}


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Have whole texts sent to Python in batches of `rows` at most, unless the session asks for fewer."""
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= rows:
        spark.conf.set(BATCH_ROWS, rows)


def kept_by(owner: str, forget: Callable[[], object]) -> None:
    """Name what an operator keeps in a Python worker between batches."""
    KEPT[owner] = forget


def alone(owner: str) -> None:
    """Have this Python worker drop what other operators keep; workers outlive the stage that began them."""
    for other, forget in KEPT.items():
        if other != owner:
            forget()


SALTS = 16


def first_by_hash(df: DataFrame, group: str, doc_id: str, k: int) -> DataFrame:
    """The `k` rows of least identifier hash of each group, with their `place` from 1.

    A group is cut by salt first, so what one task ranks in the end is at most 16 times `k` rows of a group of any size.
    """
    order = [F.xxhash64(F.col(doc_id).cast("string")), F.col(doc_id)]
    salted = df.withColumn("salt", F.pmod(F.xxhash64(F.lit("salt"), F.col(doc_id).cast("string")), F.lit(SALTS)))
    few = salted.withColumn("place", F.row_number().over(Window.partitionBy(group, "salt").orderBy(*order))).filter(F.col("place") <= k)
    ranked = few.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.filter(F.col("place") <= k).drop("salt")


def remainder(id_column: Column, divisor: int) -> Column:
    """crc32 of the id written as text, modulo `divisor`: the fold of a document."""
    return F.crc32(id_column.cast("string").cast("binary")) % divisor


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
