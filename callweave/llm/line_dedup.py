"""Lines that many documents share, found by range-partitioned line hashes and returned as keep bitmaps.

The key of a line is the line without white space at both ends and with A-Z in lower case. Every line whose key has
`least_chars` code points becomes a narrow entry: 128-bit hash of the key, document, place. Entries are partitioned by ranges of
(hash, document), sorted by hash, then document from the largest down, then place, and streamed: the first document of a key
keeps its lines, the second is held back until a third one shows that the key is common, all later ones lose theirs at once.
Only the entries of the current key's first two documents are held. A very common key spans many ranges; each range then hands on
the lines of its first two documents and a count, at most two counts a range, and the counts decide these lines.

No text is shuffled for this. A document's dropped places become a bitmap of one bit a line (1: the line stays), compressed
with zlib. A bitmap belongs to an identifier and a text (its XXH64), so it holds for every row with both.

Null texts count as empty, and an empty text is one empty line. Rows with the same identifier are one document when keys are
counted; null identifiers too are one document, smaller than all others. Repeated rows each get a row. Empty tables give
empty results; further columns pass through `deduplicate` untouched, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from callweave.llm.shared import alone, free_name, spread, table
from callweave.session import materialize

LEAST_CHARS = 20
LEAST_DOCS = 3
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
CONTINUING = bytes(range(0x80, 0xC0))
SLICE = 1 << 16
DROPPED, PENDING, COUNTED = 0, 1, 2


def line_keys(text: bytes | None, least_chars: int = LEAST_CHARS) -> tuple[int, list[int], list[bytes]]:
    """Number of lines of a UTF-8 text, the places of those whose key is long enough, and the digests of these keys."""
    lines = (text or b"").split(b"\n")
    places, digests = [], []
    for place, line in enumerate(lines):
        if len(line) < least_chars:
            continue
        key = line.strip(SPACE).lower()
        if len(key) >= least_chars and (key.isascii() or len(key.translate(None, CONTINUING)) >= least_chars):
            places.append(place)
            digests.append(xxhash.xxh3_128_digest(key))
    return len(lines), places, digests


def entries(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """One narrow row per line that may be dropped, of documents (columns doc_id, text, print)."""
    fields = [docs.schema["doc_id"], StructField("print", LongType())]
    schema = StructType(
        [*fields, StructField("n_lines", IntegerType()), StructField("place", IntegerType()), StructField("h1", LongType()), StructField("h2", LongType())]
    )

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alone("lines")
            rows: list[int] = []
            counts: list[int] = []
            places: list[int] = []
            digests: list[bytes] = []
            for row, text in enumerate(batch.column("text")):
                n, found, keys = line_keys(text.as_py(), least_chars)
                rows += [row] * len(found)
                counts += [n] * len(found)
                places += found
                digests += keys
                if len(rows) >= SLICE:
                    yield _entries_of(batch, rows, counts, places, digests)
                    rows, counts, places, digests = [], [], [], []
            yield _entries_of(batch, rows, counts, places, digests)

    narrow = docs.select("doc_id", "print", F.col("text").cast("string").cast("binary").alias("text"))
    return narrow.mapInArrow(listed, schema)


def _entries_of(batch: pa.RecordBatch, rows: list, counts: list, places: list, digests: list) -> pa.RecordBatch:
    at = pa.array(rows, pa.int32())
    halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id").take(at), batch.column("print").take(at), pa.array(counts, pa.int32()), pa.array(places, pa.int32()),
            pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])),
        ],
        ["doc_id", "print", "n_lines", "place", "h1", "h2"],
    )


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it; nulls are equal."""
    a, b = column.slice(0, len(column) - 1), column.slice(1)
    unlike = pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b)))
    return unlike.to_numpy(zero_copy_only=False).astype(bool)


class _Stream:
    """First occurrences of keys in one sorted range of entries.

    `docs` counts the open key's documents so far, `last` is the row read last, `held` has the open key's lines in its first
    documents with the documents' numbers.
    """

    def __init__(self, part: int, least_docs: int):
        self.part, self.least = part, least_docs
        self.docs, self.last, self.first_key = 0, None, True
        self.held: list[tuple[pa.Table, np.ndarray]] = []

    def _out(self, rows: pa.Table, kind: int, number: np.ndarray | int) -> pa.Table:
        n = rows.num_rows
        numbers = np.ascontiguousarray(np.broadcast_to(np.asarray(number, np.int64), n))
        out = rows.append_column("kind", pa.array(np.full(n, kind, np.int32)))
        return out.append_column("part", pa.array(np.full(n, self.part, np.int32))).append_column("number", pa.array(numbers))

    def _more(self, rows: pa.Table, new_doc: np.ndarray) -> Iterator[pa.Table]:
        """Further lines of the open key: of later documents they go, of its first ones they wait."""
        if not rows.num_rows:
            return
        number = self.docs + np.cumsum(new_doc)
        late = number >= self.least
        if late.any():
            yield self._out(rows.filter(pa.array(late)), DROPPED, 0)
        if not late.all():
            self.held.append((rows.filter(pa.array(~late)), number[~late]))
        self.docs, self.last = int(number[-1]), rows.slice(rows.num_rows - 1, 1)

    def close(self, at_end: bool) -> Iterator[pa.Table]:
        """What the open key's lines come to; the first and the last key of a range may go on in others."""
        if self.docs and (self.first_key or at_end):
            for rows, number in self.held:
                yield self._out(rows, PENDING, number)
            yield self._out(self.last, COUNTED, self.docs)
        elif self.docs >= self.least:
            for rows, number in self.held:
                yield self._out(rows.filter(pa.array(number >= 2)), DROPPED, 0)
        self.held, self.docs, self.first_key = [], 0, False

    def taken(self, rows: pa.Table) -> Iterator[pa.Table]:
        """The lines that the next rows of the range decide."""
        started = self.last is not None
        seen = (pa.concat_tables([self.last, rows]) if started else rows).combine_chunks()
        changes = {c: _differs(seen.column(c).chunk(0)) for c in ("h1", "h2", "doc_id")}
        new_key = changes["h1"] | changes["h2"]
        new_doc = new_key | changes["doc_id"]
        if not started:
            new_key, new_doc = np.r_[False, new_key], np.r_[True, new_doc]
        starts = np.flatnonzero(new_key)
        head, tail = (starts[0], starts[-1]) if len(starts) else (len(new_key), len(new_key))
        yield from self._more(rows.slice(0, head), new_doc[:head])
        if not len(starts):
            return
        yield from self.close(False)
        number = np.cumsum(new_doc[head:tail])  # of each row's document within its key
        begins = starts[:-1] - head
        if len(begins):
            lengths = np.diff(np.r_[begins, tail - head])
            number = number - np.repeat(number[begins] - 1, lengths)
            docs = np.repeat(np.maximum.reduceat(number, begins), lengths)
            gone = (number >= 2) & (docs >= self.least)
            if gone.any():
                yield self._out(rows.slice(head, tail - head).filter(pa.array(gone)), DROPPED, 0)
        yield from self._more(rows.slice(tail), new_doc[tail:])


def streamed(listed: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Entries to drop (kind 0), entries that other ranges decide (1) and the documents per range of their keys (2)."""
    extra = [StructField("kind", IntegerType()), StructField("part", IntegerType()), StructField("number", LongType())]
    names = [f.name for f in listed.schema.fields]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("lines")
        stream = _Stream(TaskContext.get().partitionId(), least_docs)
        for batch in batches:
            if batch.num_rows:
                for out in stream.taken(pa.Table.from_batches([batch]).select(names)):
                    yield from out.to_batches()
        for out in stream.close(True):
            yield from out.to_batches()

    order = ["h1", "h2", F.col("doc_id").desc_nulls_last()]
    ranged = listed.repartitionByRange(*order).sortWithinPartitions(*order, "print", "place")
    return ranged.mapInArrow(scanned, StructType([*listed.schema.fields, *extra]))


def dropped(found: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The lines that go (doc_id, print, n_lines, place), the undecided ones settled by the counts of all ranges."""
    line = ["doc_id", "print", "n_lines", "place"]
    along = Window.partitionBy("h1", "h2").orderBy("part")  # at most two counts a range
    counts = found.filter(F.col("kind") == COUNTED).select(
        "part", "h1", "h2",
        (F.sum("number").over(along) - F.col("number")).alias("before"),
        F.sum("number").over(Window.partitionBy("h1", "h2")).alias("docs"),
    )
    settled = found.filter(F.col("kind") == PENDING).join(counts, ["part", "h1", "h2"])
    settled = settled.filter((F.col("docs") >= least_docs) & (F.col("before") + F.col("number") > 1))
    return found.filter(F.col("kind") == DROPPED).select(*line).unionAll(settled.select(*line))


def packed(n_lines: int, places: np.ndarray) -> bytes:
    """Keep bitmap of `n_lines` lines without those at `places`."""
    keep = np.ones(n_lines, bool)
    keep[places] = False
    return zlib.compress(np.packbits(keep).tobytes())


def kept_lines(text: bytes | None, bitmap: bytes | None) -> tuple[int, int, bytes]:
    """Number of lines, number dropped and the lines that stay, joined by line feeds."""
    whole = text or b""
    if bitmap is None:
        return whole.count(b"\n") + 1, 0, whole
    lines = whole.split(b"\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines)).tolist()
    left = [line for line, stays in zip(lines, keep, strict=True) if stays]
    return len(lines), len(lines) - len(left), b"\n".join(left)


def text_print(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def keep_bitmaps(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS
) -> DataFrame:
    """doc_id, print, n_lines, n_dropped and keep (compressed bitmap) of every document that loses a line."""
    if least_docs < 2:
        raise ValueError("a shared line is in two documents at least")
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), text_print(F.col(text)).alias("print"))
    found = materialize(streamed(materialize(entries(spread(narrow), least_chars)), least_docs))
    lost = dropped(found, least_docs).groupBy("doc_id", "print").agg(F.max("n_lines").alias("n_lines"), F.collect_list("place").alias("places"))
    schema = StructType([lost.schema["doc_id"], StructField("print", LongType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, counts = batch.column("places"), batch.column("n_lines").to_numpy()
            maps = [packed(n, x.values.to_numpy()) for n, x in zip(counts.tolist(), lists, strict=True)]
            sizes = pc.cast(pc.list_value_length(lists), pa.int64())
            columns = [batch.column("doc_id"), batch.column("print"), pa.array(counts.astype(np.int64)), sizes, pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "print", "n_lines", "n_dropped", "keep"])

    return materialize(lost.mapInArrow(mapped, schema.add("keep", "binary")))


def _with_bitmaps(docs: DataFrame, doc_id: str, text: str, bitmaps: DataFrame, name: str) -> DataFrame:
    """`docs` with its bitmap, null where all lines stay."""
    narrow = bitmaps.select(F.col("doc_id").alias("_of"), F.col("print").alias("_print"), F.col("keep").alias(name))
    left, right = docs.alias("l"), narrow.alias("r")
    same = F.col(f"l.{doc_id}").eqNullSafe(F.col("r._of")) & (text_print(F.col(f"l.{text}")) == F.col("r._print"))
    return left.join(right, same, "left").select("l.*", f"r.{name}")


def deduplicate(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS
) -> DataFrame:
    """`docs` without the lines that `least_docs` documents share, but for the largest identifier's."""
    keep = free_name(docs.columns, "keep")
    marked = _with_bitmaps(docs, doc_id, text, keep_bitmaps(docs, doc_id, text, least_chars, least_docs), keep)

    @F.pandas_udf("binary")
    def stripped(texts, bitmaps):
        return texts.combine(bitmaps, lambda t, b: kept_lines(t, b)[2])

    whole = F.col(text).cast("string").cast("binary")
    left = F.when(F.col(keep).isNull(), F.col(text)).otherwise(stripped(whole, F.col(keep)).cast("string"))
    return marked.withColumn(text, left).select(*docs.columns)


def op11_line_dedup(spark, folder: str) -> DataFrame:
    """Every document's lines before, lines dropped and digest of what stays."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    marked = _with_bitmaps(docs, "doc_id", "text", keep_bitmaps(docs), "keep")
    schema = StructType([docs.schema["doc_id"], StructField("n_lines", LongType()), StructField("n_dropped", LongType())]).add("kept_sha256", "string")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            alone("lines")
            rows = []
            for text, keep in zip(batch.column("text"), batch.column("keep"), strict=True):
                n, gone, left = kept_lines(text.as_py(), keep.as_py())
                rows.append((n, gone, sha256(left).hexdigest()))
            n, gone, digest = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return marked.select("doc_id", F.col("text").cast("binary").alias("text"), "keep").mapInArrow(told, schema)


ORACLE = r"""
    WITH lines AS (
        SELECT doc_id, n, unnest(string_split(whole, chr(10))) AS line, generate_subscripts(string_split(whole, chr(10)), 1) AS place
        FROM (SELECT doc_id, coalesce(text, '') AS whole, row_number() OVER () AS n FROM documents)),
    keyed AS (
        SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM lines),
    common AS (
        SELECT key, max(doc_id) AS largest
        FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    marked AS (
        SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.largest AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
    SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY n, doc_id
"""
