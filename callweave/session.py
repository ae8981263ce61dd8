"""Session settings and the intermediate tables of the multi-pass operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "callweave", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the engine's settings; `master` is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the cluster's `spark.checkpoint.dir`.

    A private folder is made only in local mode, when nothing is configured.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
            shared = tempfile.mkdtemp(prefix="callweave-")
            drop_at_exit(spark, shared)
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's file system delete `path` when the application ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


_watching: list[list[str]] = []


@contextmanager
def tables() -> Iterator[list[str]]:
    """The paths of the intermediate tables written inside the block, for `drop_tables` when they have served."""
    made: list[str] = []
    _watching.append(made)
    try:
        yield made
    finally:
        _watching.remove(made)


def drop_tables(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete intermediate tables before the application ends; what reads them must have been written."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder once and read it back.

    Lost executors cost no recompute, later reads prune columns and know the true size, and loops
    do not pile up plans or inferred constraints. The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_at_exit(spark, path)
    for made in _watching:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def widen(scan: DataFrame) -> DataFrame:
    """Spread a file scan that has fewer splits than the cluster has cores.

    Multi-line CSV and single-row-group files come as one split each; text work on them would
    run in few tasks. Scans of many splits stay as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
