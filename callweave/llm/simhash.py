"""Near duplicates by SimHash fingerprints, found with Golay-code fuzzy keys.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits, each padded with zeros to a word of the
(23, 12) Golay code. That code is perfect: every word lies within three bits of exactly one codeword, so
decoding gives a 12-bit index that survives some errors. Two fingerprints that differ in four bits or fewer
differ in two or fewer bits over at least one pair of segments (each error falls in two of the three pairs).
On the path between the two pairs of words there is then a middle pair that is one bit or less from
either. Every fingerprint therefore lists, for each pair of segments, the decoded indices of its own pair of
words and of all pairs one bit away (up to eleven distinct keys of 24 bits), and the two share the key of the middle pair.
Candidates meet in an equi join on the key and are verified by their bit difference inside the join, each only
for the first pair of segments that brings it within two bits.

Equal fingerprints are linked through one entry, so a group of copies costs one row. Links become components. A key of more than 64
fingerprints is compared as `buckets` says, so that a group of near copies costs some rows each, not one a pair.

Null, empty and wordless texts have the fingerprint zero and are linked like any other. A null identifier
never names a component, but its text links others; a component of null identifiers only is null. Unlike texts of one identifier
are linked each by its own fingerprint. Repeated rows each get a row. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from callweave.llm.buckets import connected, shared_rows, side
from callweave.llm.shared import alone, free_name, small_batches, spread, table, with_row_ids
from callweave.session import materialize

SHINGLE = 4
SEED = 42
MAX_BITS = 4
WIDTHS = (22, 21, 21)
PAIRS = ((0, 1), (0, 2), (1, 2))
GENERATOR = 0b110001110101
COUNT_ROWS = 1 << 16
CROWD = 64


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a UTF-8 text: the majority bits of the XXH64 of its word shingles, as a signed long."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        hashes = [xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in spans]
    values = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(values), COUNT_ROWS):
        ones += np.unpackbits(values[start : start + COUNT_ROWS], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    @pandas_udf("long")
    def of_texts(texts: pd.Series) -> pd.Series:
        alone("simhash")
        return pd.Series([fingerprint(t, shingle, seed) for t in texts], dtype="int64")

    return of_texts(text.cast("string").cast("binary"))


def _remainder(word: int) -> int:
    """Remainder of a 23-bit polynomial by the generator, over the two-element field."""
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each 12-bit message above 11 zeros; error pattern of each syndrome."""
    rest = np.array([_remainder(m << 11) for m in range(4096)], dtype=np.int64)
    bits = [1 << b for b in range(23)]
    errors = np.zeros(2048, dtype=np.int64)
    for i in range(23):
        for j in range(i, 23):
            for k in range(j, 23):
                pattern = bits[i] | bits[j] | bits[k]
                errors[_remainder(pattern)] = pattern
    return rest, errors


def decode(words: np.ndarray) -> np.ndarray:
    """Index of the one codeword within three bits of each 23-bit word."""
    rest, errors = _golay()
    syndrome = rest[words >> 11] ^ (words & 0x7FF)
    return (words ^ errors[syndrome]) >> 11


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys: what every fingerprint lists, each key once."""
    raw = prints.view(np.uint64)
    own, near, low = [], [], 0
    for width in WIDTHS:
        words = ((raw >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
        own.append(decode(words)[:, None])
        near.append(decode((words[:, None] ^ (1 << np.arange(width))).ravel()).reshape(len(words), width))
        low += width
    rows, keys = [], []
    for p, (s, t) in enumerate(PAIRS):
        first = np.concatenate([own[s], near[s], np.repeat(own[s], WIDTHS[t], axis=1)], axis=1)
        second = np.concatenate([own[t], np.repeat(own[t], WIDTHS[s], axis=1), near[t]], axis=1)
        listed = np.sort((p << 24) | (first << 12) | second, axis=1)
        new = np.ones(listed.shape, bool)
        new[:, 1:] = listed[:, 1:] != listed[:, :-1]
        rows.append(np.nonzero(new)[0])
        keys.append(listed[new])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(prints: DataFrame) -> DataFrame:
    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["print"].to_numpy(np.int64)
            rows, keys = fuzzy_keys(values)
            yield pd.DataFrame({"key": keys.astype(np.int32), "print": values[rows], "node": batch["node"].to_numpy(np.int64)[rows]})

    return materialize(prints.select("print", "node").mapInPandas(listed, "key int, print long, node long"))


def _apart() -> Column:
    return F.col("print_a").bitwiseXOR(F.col("print_b"))


def _first_close() -> Column:
    """Whether the key is one of the first pair of segments that brings the fingerprints within two bits."""
    masks = [_mask(s) | _mask(t) for s, t in PAIRS]
    close = [F.bit_count(_apart().bitwiseAND(F.lit(_signed(m)))) <= MAX_BITS // 2 for m in masks]
    pair = F.shiftright("key_a", 24)
    return ((pair == 0) & close[0]) | ((pair == 1) & ~close[0] & close[1]) | ((pair == 2) & ~close[0] & ~close[1] & close[2])


def _met(keyed: DataFrame, max_bits: int) -> DataFrame:
    verified = (F.col("print_a") < F.col("print_b")) & (F.bit_count(_apart()) <= max_bits) & _first_close()
    found = side(keyed, "a").join(side(keyed, "b"), (F.col("key_a") == F.col("key_b")) & verified)
    return found.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _checked(max_bits: int) -> int:
    if max_bits > MAX_BITS:
        raise ValueError(f"the keys find differences of up to {MAX_BITS} bits")
    return max_bits


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints differ in `max_bits` bits or fewer.

    `prints` has distinct fingerprints (`print`) with a long `node` each. `max_bits` may be at most four.
    """
    return _met(_keyed(prints), _checked(max_bits))


def linked(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(node, root) of the components of `links`, without a row for every link where many fingerprints share a key."""
    test = F.bit_count(_apart()) <= _checked(max_bits)
    shared = materialize(shared_rows(_keyed(prints)))
    few = materialize(_met(shared.filter(F.col("n") <= CROWD).select("key", "print", "node"), max_bits))
    crowded = shared.filter(F.col("n") > CROWD).drop("print")
    return connected(crowded, prints.select("node", "print"), few, test, _first_close())


def _mask(segment: int) -> int:
    return ((1 << WIDTHS[segment]) - 1) << sum(WIDTHS[:segment])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, print (long) and component_id of every row."""
    small_batches(docs.sparkSession)
    whole = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    printed = materialize(whole.select("doc_id", fingerprints(F.col("text")).alias("print")))
    least = printed.groupBy("print").agg(F.min("doc_id").alias("least"))
    nodes = materialize(least.withColumn("node", F.monotonically_increasing_id()))
    found = linked(nodes, max_bits)
    rooted = materialize(nodes.join(found, "node", "left").select("print", "least", F.coalesce("root", "node").alias("root")))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return printed.join(rooted.join(names, "root").select("print", "component_id"), "print").select("doc_id", "print", "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """`docs` with one row of each group of near duplicates: the least identifier, nulls last."""
    row = free_name(docs.columns, "row")
    placed = with_row_ids(docs, row)
    narrow = placed.select(F.col(row).alias("row"), F.col(doc_id).alias("id"))
    grouped = groups(placed, row, text, max_bits).withColumnRenamed("doc_id", "row").join(narrow, "row")
    rank = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    kept = grouped.groupBy("component_id").agg(F.min_by("row", rank).alias(row)).select(row)
    return placed.join(kept, row, "left_semi").select(*docs.columns)


def op5_simhash_golay(spark, folder: str) -> DataFrame:
    found = groups(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
