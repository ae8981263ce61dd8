"""Market tables by name, from Parquet folders or a JDBC connection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave import schemas
from callweave.functions import nulls


class ParquetMarket:
    """Tables below one folder, one sub-folder or file per table."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        rows = self._spark.read.schema(schemas.MARKET[name]).parquet(f"{self._path}/{name}")
        return nulls.nan_to_null(rows)


class JdbcMarket:
    """Tables of a remote database; filters and columns are pushed into its SQL by Spark.

    `names` maps our table names to the remote ones; `options` go to the JDBC reader (with
    partitionColumn, lowerBound, upperBound and numPartitions for parallel reads).
    """

    def __init__(self, spark: SparkSession, url: str, names: dict[str, str] | None = None, **options: str):
        self._spark, self._url, self._names, self._options = spark, url, names or {}, options

    def table(self, name: str) -> DataFrame:
        reader = self._spark.read.format("jdbc").options(url=self._url, dbtable=self._names.get(name, name))
        rows = reader.options(**self._options).load()
        wanted = schemas.MARKET[name].fields
        return nulls.nan_to_null(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted]))


def event_rows(spark: SparkSession, events: list[dict]) -> DataFrame:
    """A small list of {permno, edate, sentiment} given in code, dates in either format."""
    from callweave.functions import dates

    schema = "permno bigint, edate string, sentiment double"
    listed = [(int(e["permno"]), e["edate"], float(e.get("sentiment", 0))) for e in events]
    return spark.createDataFrame(listed, schema).withColumn("edate", dates.parse_date(F.col("edate")))
