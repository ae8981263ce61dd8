"""Latest open record: for each (key, instant) the record that covers the instant and began last, in one ordered sweep.

Records and lookups are sorted together by key and instant, records first, and each range is swept once. The sweep holds the skyline of
the key's open records: a record that begins later and does not end sooner hides the earlier ones, so ends fall from the bottom of
the stack to its top, ended records are popped for good, and the top is the answer. A record is pushed and popped once: the work is
linear in records and lookups, and no row is made for a (lookup, record) pair.

A key may span ranges. What a range cannot answer has instants after its start, so every earlier record of the key has begun: the
answer is in the last earlier range whose skyline reaches as far as the instant, and there it is the record with the least end
that still covers it. The ranges' reaches are one row a range, and the record comes from a second ordered scan, over skylines only.

Null keys, instants and starts never match; a null end is open. Records that end before they begin never match.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from callweave.operators import scan
from callweave.session import materialize

OPEN = 2**62
ANSWERED, WAITING, STANDING = 0, 1, 2


def latest_open(lookups: DataFrame, records: DataFrame, key: str, at: str, start: str, end: str, take: str) -> DataFrame:
    """Distinct lookups (`key`, `at`) with `take` (a long) and `start` of their record, null where none covers them.

    `at`, `start` and `end` are dates. Of records that begin together the greatest `take` wins.
    """
    asked = lookups.select(key, F.unix_date(at).cast("long").alias("at")).dropna().distinct()
    stop = F.coalesce(F.unix_date(end).cast("long"), F.lit(OPEN))
    known = records.select(key, F.unix_date(start).cast("long").alias("at"), F.col(take).cast("long").alias("take"), stop.alias("end"))
    known = known.dropna(subset=[key, "at"]).filter("at <= end")
    none = F.lit(None).cast("long")
    both = known.withColumn("asks", F.lit(False)).unionByName(asked.withColumns({"take": none, "end": none, "asks": F.lit(True)}))
    order = [key, "at", "asks", F.col("take").asc_nulls_first()]
    ranged = materialize(both).repartitionByRange(*order).sortWithinPartitions(*order)
    swept = materialize(_swept(ranged, key))

    answered = swept.filter(F.col("kind") == ANSWERED).select(key, "at", "take", "began")
    standing = swept.filter(F.col("kind") == STANDING)
    reach = standing.groupBy(key, "part").agg(F.max("end").alias("reach"))
    reaches = reach.groupBy(key).agg(F.collect_list(F.struct("part", "reach")).alias("reaches"))  # one entry a range at most
    covering = F.filter("reaches", lambda r: (r["part"] < F.col("part")) & (r["reach"] >= F.col("at")))
    waiting = swept.filter(F.col("kind") == WAITING).select(key, "at", "part").join(reaches, key, "left")
    aimed = waiting.select(key, "at", F.array_max(F.transform(covering, lambda r: r["part"])).alias("part"))
    # in that range the least end that covers the instant: a scan from the latest instant down, records first
    skylines = standing.select(key, "part", F.col("end").alias("spot"), "take", "began", F.lit(False).alias("asks"))
    asks = aimed.filter("part IS NOT NULL").select(key, "part", F.col("at").alias("spot"), none.alias("take"), none.alias("began"), F.lit(True).alias("asks"))
    met = scan.running(
        skylines.unionByName(asks), [key, "part"], [F.desc("spot"), F.col("asks"), F.col("began").asc_nulls_first(), F.col("take").asc_nulls_first()],
        found=scan.latest(F.when(~F.col("asks"), F.struct("take", "began"))),
    )
    late = met.filter("asks").select(key, F.col("spot").alias("at"), F.col("found.take").alias("take"), F.col("found.began").alias("began"))
    lost = aimed.filter("part IS NULL").select(key, "at", none.alias("take"), none.alias("began"))
    day = lambda c: F.date_from_unix_date(F.col(c).cast("int"))
    return answered.unionByName(late).unionByName(lost).select(key, day("at").alias(at), F.col("take").alias(take), day("began").alias(start))


def _swept(ranged: DataFrame, key: str) -> DataFrame:
    number = [StructField(c, LongType()) for c in ("at", "take", "began", "end")]
    schema = StructType([ranged.schema[key], *number, StructField("part", IntegerType()), StructField("kind", IntegerType())])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, now, stack = TaskContext.get().partitionId(), True, None, []
        for batch in batches:
            names, out = batch.column(key).to_pylist(), []
            columns = [batch.column(c).to_pylist() for c in ("at", "take", "end", "asks")]
            for name, at, take, end, asks in zip(names, *columns, strict=True):
                if name != now:
                    first, now, stack = now is None, name, []
                if not asks:
                    while stack and stack[-1][2] <= end:
                        stack.pop()
                    stack.append((at, take, end))
                    continue
                while stack and stack[-1][2] < at:
                    stack.pop()
                if stack:
                    out.append((name, at, stack[-1][1], stack[-1][0], None, part, ANSWERED))
                else:
                    out.append((name, at, None, None, None, part, WAITING if first else ANSWERED))
            yield _batch(out, schema)
        yield _batch([(now, None, take, at, end, part, STANDING) for at, take, end in stack], schema)

    return ranged.select(key, "at", "take", "end", "asks").mapInArrow(sweep, schema)


def _batch(rows: Sequence[tuple], schema: StructType) -> pa.RecordBatch:
    kinds = [pa.string() if f.dataType.typeName() == "string" else pa.int32() if isinstance(f.dataType, IntegerType) else pa.int64() for f in schema.fields]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], schema.names)
