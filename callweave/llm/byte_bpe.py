"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary is a file of byte ranks. For the library, bytes are mapped to printable characters, tokens
are renamed by that map, and the merges are derived from the ranks: every split of a token into two tokens, in
the order of the token's rank. A text is cut by the published pattern; each distinct piece of a batch is encoded
once and remembered in a table of bounded size, which changes the time but not the result.

Offsets are in characters of the text. A token that holds a part of a character only (split characters) has the
offsets of the whole character. Decoding maps ids back to bytes; bytes of one text always make the text again,
while a slice of the ids may begin or end inside a character: `decode` gives the bytes, `decode_text` puts the
replacement character there.

Null and empty texts have no ids; null ids decode to no bytes. Rows that repeat are encoded each. Further columns pass
through, and a clashing output column replaces the input's.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from callweave.llm.shared import alone, kept_by, sha256_hex, small_batches, spread, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
REMEMBERED = 300_000
BATCH_BYTES = 4 << 20


def byte_characters() -> list[str]:
    """Character of each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@lru_cache(1)
def young_characters() -> tuple[re.Pattern, re.Pattern]:
    """A quick and an exact pattern for characters that this Python's Unicode tables do not know.

    Regular-expression libraries of other Unicode versions may class these otherwise.
    """
    starts, before = [], False
    for point in range(0x110000):
        unknown = unicodedata.category(chr(point)) == "Cn"
        if unknown != before:
            starts.append(point)
        before = unknown
    starts += [0x110000] * (len(starts) % 2)
    ranges = list(zip(starts[::2], starts[1::2], strict=True))
    exact = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b - 1))}" for a, b in ranges)
    low = "".join(f"{re.escape(chr(a))}-{re.escape(chr(min(b, 0x10000) - 1))}" for a, b in ranges if a < 0x10000)
    return re.compile(f"[{low}\U00010000-\U0010ffff]"), re.compile(f"[{exact}]")


@lru_cache(2)
def token_bytes(path: str) -> list[bytes]:
    """Bytes of each token by its rank; all that decoding needs."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [ranks.get(i, b"") for i in range(max(ranks, default=-1) + 1)]


class ByteBpe:
    """Encoder of one vocabulary file; made once per worker by `loaded`."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = {token: rank for rank, token in enumerate(token_bytes(path)) if token}
        characters = byte_characters()
        name = {token: "".join([characters[b] for b in token]) for token in ranks}
        merges: list[tuple[str, str]] = []
        for token in sorted(ranks, key=ranks.__getitem__):
            halves = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            halves.sort(key=lambda h: (ranks[h[0]], ranks[h[1]]))
            merges += [(name[a], name[b]) for a, b in halves]
        self.library = Tokenizer(models.BPE({name[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pattern = regex.compile(pattern)
        self.quick, self.exact = young_characters()
        self.library_split = pre_tokenizers.Split(Regex(pattern), "isolated")
        self.known: dict[str, array] = {}
        self.old: dict[str, array] = {}

    def split(self, text: str) -> list[str]:
        """Matches of the pattern; by the library itself where Unicode versions could matter."""
        if self.quick.search(text) and self.exact.search(text):
            return [piece for piece, _ in self.library_split.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def _learn(self, pieces: set[str]) -> None:
        """Know these pieces; two generations, so that common pieces outlive rare ones."""
        new = [p for p in pieces if p not in self.known]
        if new and len(self.known) + len(new) > REMEMBERED // 2:
            self.old, self.known = self.known, {}
            new = list(pieces)
        fresh = [p for p in new if p not in self.old]
        self.known.update((p, self.old[p]) for p in new if p in self.old)
        for piece, found in zip(fresh, self.library.encode_batch_fast(fresh, add_special_tokens=False), strict=True):
            self.known[piece] = array("i", found.ids)

    def encode(self, text: str) -> array:
        """Token ids of one text."""
        pieces = self.split(text)
        self._learn(set(pieces))
        known, ids = self.known, array("i")
        for piece in pieces:
            ids.extend(known[piece])
        return ids

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """First character of each token and the one after its last."""
        spans: list[tuple[int, int]] = []
        at = 0
        for piece in self.split(text):  # the pieces make up the whole text
            spans += [(at + a, at + b) for a, b in self.library.encode(piece, add_special_tokens=False).offsets]
            at += len(piece)
        return spans

def decoded(ids: list[int], tokens: list[bytes]) -> bytes:
    return b"".join([tokens[i] for i in ids])


@lru_cache(2)
def loaded(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


kept_by("byte_bpe", loaded.cache_clear)


def _slices(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about BATCH_BYTES by `sizes`, one row at least."""
    part = (np.cumsum(sizes) - sizes) // BATCH_BYTES
    edges = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), len(sizes)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


def _lists(column: pa.Array) -> Iterator[list[int]]:
    """The id lists of a column without nulls, cut from one flat array."""
    flat = column.flatten()
    if flat.null_count:
        yield from ([i for i in v or () if i is not None] for v in column.to_pylist())
        return
    values = flat.to_numpy()
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True) if len(ends) else ():
        yield values[a:b].tolist()


def _ends(values: list) -> pa.Array:
    return pa.array(np.cumsum([0, *map(len, values)]), pa.int32())


def _id_lists(values: list[array]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.int32), *[np.frombuffer(v, np.int32) for v in values]])
    return pa.ListArray.from_arrays(_ends(values), pa.array(flat, pa.int32()))


def _span_lists(values: list[list[tuple[int, int]]]) -> pa.Array:
    flat = np.array([span for spans in values for span in spans], dtype=np.int32).reshape(-1, 2)
    parts = [pa.array(np.ascontiguousarray(flat[:, k]), pa.int32()) for k in (0, 1)]
    return pa.ListArray.from_arrays(_ends(values), pa.StructArray.from_arrays(parts, ["start", "end"]))


def _replaced(
    df: DataFrame, column: str, outs: dict[str, str], per_value: int, make: Callable[[pa.Array], list[pa.Array]]
) -> DataFrame:
    """`df` with `outs` (name, type), which `make` derives from the values of `column`, in place of it.

    `per_value` times the length of a value is taken as its size in bytes when batches are cut.
    """
    gone = {column.lower(), *map(str.lower, outs)}
    others = [c for c in df.columns if c.lower() not in gone]
    source = df.select(*others, F.col(column).alias("__value"))
    names = [*others, *outs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(len(others))
            lengths = pc.list_value_length(whole) if pa.types.is_list(whole.type) else pc.binary_length(whole)
            for part in _slices(batch, per_value * pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64)):
                made = make(part.column(len(others)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(others)], *made], names)

    fields = [*source.select(*others).schema.fields]
    schema = StructType([*fields, *[StructField(n, _parse(df, t)) for n, t in outs.items()]])
    return source.mapInArrow(run, schema)


def _parse(df: DataFrame, kind: str) -> DataType:
    return df.sparkSession.createDataFrame([], f"x {kind}").schema[0].dataType


def encode(
    df: DataFrame, text: str = "text", out: str = "ids", vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN,
    offsets: str | None = None, decoded_sha256: str | None = None,
) -> DataFrame:
    """`df` with the token ids in place of the text.

    `offsets` names a further column of (start, end) spans, `decoded_sha256` one of the digest of the bytes that the ids
    decode to.
    """
    path = public_tokenizers.path(vocabulary)

    def make(column: pa.Array) -> list[pa.Array]:
        alone("byte_bpe")
        bpe, texts = loaded(path, pattern), column.to_pylist()
        ids = [bpe.encode(t or "") for t in texts]
        made = [_id_lists(ids)]
        if offsets is not None:
            made.append(_span_lists([bpe.offsets(t or "") for t in texts]))
        if decoded_sha256 is not None:
            known = token_bytes(path)
            made.append(pa.array([sha256_hex(decoded(i, known)) for i in ids], pa.string()))
        return made

    outs = {out: "array<int>"}
    outs |= {offsets: "array<struct<start: int, end: int>>"} if offsets else {}
    outs |= {decoded_sha256: "string"} if decoded_sha256 else {}
    small_batches(df.sparkSession)
    return _replaced(df.withColumn(text, F.col(text).cast("string")), text, outs, 1, make)


def decode(df: DataFrame, ids: str = "ids", out: str = "bytes", vocabulary: str = VOCABULARY) -> DataFrame:
    """`df` with the bytes in place of the token ids."""
    path = public_tokenizers.path(vocabulary)

    def make(column: pa.Array) -> list[pa.Array]:
        known = token_bytes(path)
        return [pa.array([decoded(v, known) for v in _lists(column)], pa.binary())]

    return _replaced(df, ids, {out: "binary"}, 4, make)


def decode_text(df: DataFrame, ids: str = "ids", out: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """As `decode`, as text; bytes that begin or end inside a character become the replacement character."""
    path = public_tokenizers.path(vocabulary)

    def make(column: pa.Array) -> list[pa.Array]:
        known = token_bytes(path)
        return [pa.array([decoded(v, known).decode("utf-8", "replace") for v in _lists(column)], pa.string())]

    return _replaced(df, ids, {out: "string"}, 4, make)


def digests(encoded: DataFrame, ids: str = "ids") -> DataFrame:
    """n_tokens, and the SHA-256 of the ids and of the bytes they decode to, in place of the ids."""
    sized = encoded.withColumns(
        {
            "n_tokens": F.size(ids).cast("long"),
            "ids_sha256": F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256),
        }
    )
    return decode(sized, ids, "_decoded").withColumn("decoded_sha256", F.sha2("_decoded", 256)).drop("_decoded")


def op9_byte_bpe(spark, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return digests(encode(docs))
