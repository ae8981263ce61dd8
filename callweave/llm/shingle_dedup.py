"""Near duplicates by the Jaccard coefficient of word shingles, on top of the fingerprint links of `simhash`.

Two texts are linked if their fingerprints are (see `simhash`) or if their sets of five-word shingles have a coefficient of 0.8
or more. Sets are held as 64-bit hashes. Candidates come from minima of 96 hash orders in 24 bands of four: a pair at 0.8 shares no band
with probability (1 - 0.8^4)^24 = 3e-6, a closer one less. Every candidate is verified on the whole sets.

Texts with equal sets go in as one. Band keys are compared as `buckets` says, beginning with the components of the fingerprints, a pair only
in its first common band: no pair of different components is left out, rows that are joined never meet, and a group of near
copies costs some rows each, not one a pair.

Before any text is read, a pair must pass what its sketches prove. A set's odd sketch has a bit for every residue of its hashes, set if an
odd number of them fall on it; two sketches differ in no more bits than the sets have unlike members. At a coefficient j these
are at most (1 - j) / (1 + j) of both sizes together, so a pair that differs in more bits cannot reach it: the test in the
join condition drops pairs, never links. A sketch has four times as many bits as the set has members, rounded up to a power of two (64 at
least), so that few pairs below the limit pass; a longer one is folded for a shorter one.

Texts of fewer than five words are one shingle. Null, empty and wordless texts have none and are left to the fingerprints. Repeated
rows fall in one group. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm import simhash
from callweave.llm.buckets import connected, shared_rows
from callweave.llm.shared import alone, free_name, small_batches, spread, with_row_ids
from callweave.session import materialize

SHINGLE = 5
LEAST = 0.8
BANDS = 24
ROWS = 4
SPARE = 4
BLOCK = 2048
_SEEDS = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64)
_FLIPS, _ODDS = _SEEDS[0], _SEEDS[1] | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _stirred(values: np.ndarray) -> np.ndarray:
    """Finalizer of SplitMix64: every bit depends on all."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a UTF-8 text, words in lower case as for the fingerprint."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - shingle + 1)
    rolled = np.zeros(n, np.uint64)
    for i in range(min(shingle, len(words))):
        rolled = rolled * _STEP + hashes[i : i + n]
    return np.unique(_stirred(rolled))


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key per band of a set of shingles that is not empty, as signed longs."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), BLOCK):
        least = np.minimum(least, ((found[start : start + BLOCK, None] ^ _FLIPS) * _ODDS).min(axis=0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = _stirred(keys * _STEP + column)
    return keys.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def odd_sketch(found: np.ndarray) -> np.ndarray:
    """Parity of the members on each residue, as longs."""
    bits = max(64, 1 << max(0, SPARE * len(found) - 1).bit_length())
    counts = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(bool), bitorder="little").view(np.int64)


def sketches(texts: DataFrame) -> DataFrame:
    """node, number of distinct shingles, hash of the set, band keys and odd sketch of every text (columns node, text) with a word."""

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            alone("shingles")
            sets = [shingles(t) for t in batch["text"]]
            rows = [
                (n, len(s), xxhash.xxh3_128_digest(s.tobytes()), band_keys(s), odd_sketch(s))
                for n, s in zip(batch["node"], sets, strict=True) if len(s)
            ]
            yield pd.DataFrame(rows, columns=["node", "size", "whole", "keys", "odd"])

    narrow = texts.select("node", F.col("text").cast("string").cast("binary").alias("text"))
    return narrow.mapInPandas(sketched, "node long, size int, whole binary, keys array<long>, odd array<long>")


def _folded(longer: Column, shorter: Column) -> Column:
    """A sketch at the length of one that has half or a quarter of its bits, or as it is."""
    half = lambda v: F.zip_with(F.slice(v, 1, (F.size(v) / 2).cast("int")), F.slice(v, (F.size(v) / 2 + 1).cast("int"), (F.size(v) / 2).cast("int")), lambda x, y: x.bitwiseXOR(y))  # noqa: E731, E501
    return F.when(F.size(longer) <= F.size(shorter), longer).when(F.size(longer) == 2 * F.size(shorter), half(longer)).otherwise(half(half(longer)))


def possible(least: float) -> Column:
    """Whether sketches (size_a, odd_a, size_b, odd_b) leave room for the coefficient."""
    both = F.col("size_a") + F.col("size_b")
    fits = F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b")
    a, b = F.col("odd_a"), F.col("odd_b")
    unlike = F.aggregate(F.zip_with(_folded(a, b), _folded(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    return F.when(fits, unlike <= (1 - least) / (1 + least) * both + 1e-6).otherwise(F.lit(False))


def verified(pairs: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs (a, b) whose texts reach the coefficient."""

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            alone("shingles")
            kept, last, own = [], None, None
            for a, x, y in zip(batch["a"], batch["text_a"], batch["text_b"], strict=True):
                if a != last:
                    last, own = a, shingles(x)
                kept.append(jaccard(own, shingles(y)) >= least)
            yield batch.loc[kept, ["a", "b"]]

    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    few = materialize(texts.join(materialize(ends), "node", "left_semi"))
    sides = [few.select(F.col("node").alias(s), F.col("text").cast("string").cast("binary").alias(f"text_{s}")) for s in "ab"]
    return pairs.join(sides[1], "b").join(sides[0], "a").select("a", "b", "text_a", "text_b").mapInPandas(compared, "a long, b long")


def links(texts: DataFrame, least: float = LEAST, known: DataFrame | None = None) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of texts (columns node, text) that reach the coefficient, and of `known` ones."""
    if not 0.5 <= least <= 1:
        raise ValueError("the bands find coefficients of one half and more, reliably from 0.8")
    found = materialize(sketches(spread(texts)))
    equal = found.groupBy("size", "whole").agg(F.min("node").alias("a"), F.max("node").alias("last")).filter("a < last")
    same = materialize(found.join(equal, ["size", "whole"]).filter("a < node").select("a", F.col("node").alias("b")))
    alone_ = found.join(same.select(F.col("b").alias("node")), "node", "left_anti")
    shared = materialize(shared_rows(alone_.select("node", F.posexplode("keys").alias("band", "key"))))
    facts = materialize(found.select("node", "size", "keys", "odd").join(shared.select("node").distinct(), "node", "left_semi"))
    first = F.array_position(F.zip_with("keys_a", "keys_b", lambda x, y: x == y), True) == F.col("band_a") + 1
    before = same if known is None else materialize(same.unionAll(known.select("a", "b")))
    roots = connected(shared, facts, before, possible(least), first, lambda pairs: verified(pairs, texts, least))
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def groups(texts: DataFrame, least: float = LEAST) -> DataFrame:
    """node and component_id of every row of a stored table of texts (columns node: long and unique, text)."""
    small_batches(texts.sparkSession)
    printed = simhash.groups(texts, "node", "text").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    linked = materialize(printed.filter("a <> b"))
    found = links(texts, least, linked)
    return texts.select("node").join(found.select(F.col("a").alias("node"), "b"), "node", "left").select("node", F.coalesce("b", "node").alias("component_id"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """`docs` with one row of each group of near duplicates: the least identifier, nulls last."""
    row = free_name(docs.columns, "row")
    placed = with_row_ids(docs, row)
    grouped = materialize(groups(placed.select(F.col(row).alias("node"), F.col(text).alias("text")), least))
    named = grouped.join(placed.select(F.col(row).alias("node"), F.col(doc_id).alias("id")), "node")
    rank = F.struct(F.col("id").isNull(), F.col("id"), F.col("node"))
    kept = named.groupBy("component_id").agg(F.min_by("node", rank).alias("node"))
    # the few rows that go are looked up, so that texts are not shuffled for those that stay
    gone = materialize(grouped.select("node").join(kept, "node", "left_anti").select(F.col("node").alias(row)))
    return placed.join(gone, row, "left_anti").select(*docs.columns)
