"""Periodic runs of words, found with a suffix automaton whose link tree is read by link-cut accesses.

A run is a stretch of words with smallest period q (words q apart are equal) that no neighbouring word extends. Wanted are runs
of `LEAST_WORDS` words and `EXPONENT` periods at least.

The suffix links of a text's automaton form a tree; the path from a prefix's state to the root holds all its suffixes, grouped by
where they ended last. Preferred paths of a link-cut tree are these groups: the words are appended one by one, and each access
turns the path of the new prefix into one preferred path, coloured by the new end. What the access cuts off on its way are path segments of one
colour each: the longest string of a segment, `l` words long, ended last at `e`. If the distance d from `e` to the new end is at most `l`,
then two copies of d words stand next to each other: a square of period d. A run shows itself so at its second period at the latest, as
the last end of its last q words is q words back, and the square is extended to both sides in the text once a run. An access changes
O(log n) segments on average, so a text of n words takes O(n log n) steps and O(n) memory, however many runs it has.

Words that cannot be in a run are not appended. In a run of e periods the words after the first period, m = (e - 1) q at least,
all stand within q <= m / (e - 1) of their last occurrence. So a stretch of m words is cut wherever a word's last occurrence is further
back than m / (e - 1), and the parts again, until nothing is left to cut; what is left, with room for a first period before it, goes to
the automaton. This drops no run. Runs are extended in the whole text.

Null texts count as empty; texts without words have no runs. A null identifier is only carried along. Repeated rows each get a row.
Empty tables give empty results. One text is the unit of work: a text of n words takes some hundred bytes a word in its task.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from callweave.llm.shared import alone, free_name, spread, table

LEAST_WORDS = 6
EXPONENT = 4
SLICE_BYTES = 8 << 20


def numbered(words: list[bytes]) -> list[int]:
    """Equal words by equal numbers from 0."""
    known: dict[bytes, int] = {}
    return [known.setdefault(w, len(known)) for w in words]


def stretches(ids: np.ndarray, least: int = LEAST_WORDS, exponent: int = EXPONENT) -> list[tuple[int, int]]:
    """The (start, end) of the parts of a text that can hold a run."""
    n = len(ids)
    if n < least:
        return []
    narrow = np.uint16 if n < 1 << 16 else np.int64  # short integers are sorted by radix
    order = np.argsort(ids.astype(narrow), kind="stable")
    back = np.full(n, n, np.int64)  # distance to the word's last occurrence
    same = ids[order[1:]] == ids[order[:-1]]
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    found, waiting, short = [], [(0, n)], max(1, least - max(1, least // exponent))
    while waiting:
        a, b = waiting.pop()
        most = (b - a) // (exponent - 1)
        cuts = np.flatnonzero(back[a:b] > most) + a
        if not len(cuts):
            found.append((max(0, a - most), b))
            continue
        edges = np.r_[a - 1, cuts, b]
        for k in np.flatnonzero(np.diff(edges) > short):
            waiting.append((int(edges[k]) + 1, int(edges[k + 1])))
    return sorted(found)


def automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links and lengths of the states, and the state of every prefix; state 1 is the root, 0 stands for none."""
    moves: list[dict[int, int]] = [{}, {}]
    link, length, prefix, last = [0, 0], [0, 0], [], 1
    for c in ids:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(1)
        p = last
        while p and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(moves[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        prefix.append(new)
        last = new
    return link, length, prefix


class LinkCut:
    """Preferred paths of a rooted tree as splay trees by depth; every path has one colour."""

    def __init__(self, parent: list[int]):
        self.up = parent.copy()  # in the splay tree; of its root: the tree node above the path
        self.left, self.right = [0] * len(parent), [0] * len(parent)
        self.colour = [-1] * len(parent)  # of a path, at its splay root

    def _splay(self, x: int) -> None:
        up, left, right, colour = self.up, self.left, self.right, self.colour
        while True:
            y = up[x]
            if not y or (left[y] != x and right[y] != x):
                return
            z = up[y]
            inner = z and (left[z] == y or right[z] == y)
            if inner and (left[z] == y) == (left[y] == x):
                self._rotate(y, z)
                self._rotate(x, y)
            elif inner:
                self._rotate(x, y)
                self._rotate(x, z)
            else:
                colour[x] = colour[y]
                self._rotate(x, y)
                return
            if not (w := up[x]) or (left[w] != x and right[w] != x):
                colour[x] = colour[z]
                return

    def _rotate(self, x: int, y: int) -> None:
        up, left, right = self.up, self.left, self.right
        z = up[y]
        if left[y] == x:
            b = left[y] = right[x]
            right[x] = y
        else:
            b = right[y] = left[x]
            left[x] = y
        if b:
            up[b] = y
        up[y] = x
        up[x] = z
        if z:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x

    def access(self, node: int, colour: int) -> list[tuple[int, int]]:
        """Make the path from the root to `node` one path of that colour; (deepest node, colour) of the segments it is made of."""
        up, right, colours = self.up, self.right, self.colour
        met, x, lower = [], node, 0
        while x:
            self._splay(x)
            if r := right[x]:
                colours[r] = colours[x]
            met.append((x, colours[x]))
            right[x] = lower
            lower = x
            x = up[x]
        self._splay(node)
        colours[node] = colour
        return met


def squares(ids: list[int]) -> Iterator[tuple[int, int, int]]:
    """(end, d, l): the last `l` words up to `end`, d of them at least, stand also d words further back, and there last."""
    link, length, prefix = automaton(ids)
    paths = LinkCut(link)
    for end, state in enumerate(prefix):
        for node, last in paths.access(state, end):
            if last >= 0 and end - last <= length[node]:
                yield end, end - last, length[node]


def runs(ids: list[int], least: int = LEAST_WORDS, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of `least` words and `exponent` periods, by start, then period."""
    if exponent < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    n, found = len(ids), {}
    for a, b in stretches(np.array(ids, np.int64), least, exponent):
        reached: dict[int, int] = {}  # last word of the run of each period that was seen last
        for at, period, known in squares(ids[a:b]):
            end = a + at
            if reached.get(period, -1) >= end:
                continue
            first, past = end - known, end + 1
            while first >= period and ids[first] == ids[first - period]:
                first -= 1
            while past < n and ids[past] == ids[past - period]:
                past += 1
            reached[period] = past - 1
            start = first + 1 - period
            if past - start >= max(least, exponent * period):
                found[start, past] = min(period, found.get((start, past), period))
    return sorted((start, past - start, period) for (start, past), period in found.items())


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run has after its first period."""
    if not found:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


Rewrite = Callable[[list[bytes], int | None], list[bytes]]
RUN = StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())])


def periodic_runs(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least: int = LEAST_WORDS,
    exponent: int = EXPONENT,
    rewrite: Rewrite | None = None,
) -> DataFrame:
    """doc_id, `runs` (start, length and period of each, by start) and `collapsed` (the text without the repeats) of every row.

    `rewrite` gives other words to look at, from a text's words and the crc32 of its identifier (null for a null one).
    """
    schema = StructType([StructField("doc_id", docs.schema[doc_id].dataType), StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alone("runs")
            from_row, size, lists, texts = 0, 0, [], []
            for row, (name, value) in enumerate(zip(batch.column("name"), batch.column("text"), strict=True)):
                words = (value.as_py() or b"").split()
                if rewrite:
                    words = rewrite(words, zlib.crc32(name.as_py()) if name.is_valid else None)
                found = runs(numbered(words), least, exponent) if len(words) >= least else []
                lists.append(found)
                texts.append(b" ".join(collapsed(words, found)))
                size += len(texts[-1])
                if size >= SLICE_BYTES:
                    yield _told_of(batch.column("doc_id").slice(from_row, len(texts)), lists, texts)
                    from_row, size, lists, texts = row + 1, 0, [], []
            yield _told_of(batch.column("doc_id").slice(from_row, len(texts)), lists, texts)

    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(doc_id).cast("string").cast("binary").alias("name"), F.col(text).cast("string").cast("binary").alias("text")
    )
    return spread(narrow).mapInArrow(told, schema)


def _told_of(ids: pa.Array, lists: list, texts: list[bytes]) -> pa.RecordBatch:
    flat = np.array([run for found in lists for run in found], np.int64).reshape(-1, 3)
    ends = np.cumsum([0, *map(len, lists)])
    parts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], ["start", "length", "period"])
    of_rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)
    return pa.RecordBatch.from_arrays([ids, of_rows, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])


def collapse(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with every text that has a run without the run's repeats; texts without runs stay as they are."""
    out = free_name(docs.columns, "collapsed")

    @F.pandas_udf("string")
    def shortened(texts):
        alone("runs")
        return texts.map(_shortened)

    marked = docs.withColumn(out, shortened(F.col(text).cast("string").cast("binary")))
    return marked.withColumn(text, F.coalesce(out, text)).select(*docs.columns)


def _shortened(text: bytes | None) -> str | None:
    words = (text or b"").split()
    found = runs(numbered(words)) if len(words) >= LEAST_WORDS else []
    return b" ".join(collapsed(words, found)).decode() if found else None


def planted(words: list[bytes], crc: int | None) -> list[bytes]:
    """The words with a period from some place on, for every tenth checksum."""
    n = len(words)
    if crc is None or crc % 10 or not n:
        return words
    g = crc // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op13_word_runs(spark, folder: str) -> DataFrame:
    """Runs of every document, some with planted periods: their number, the longest, and digests of the list and of the rest."""
    found = periodic_runs(table(spark, folder, "documents"), rewrite=planted)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rank = F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.when(F.size("runs") > 0, F.array_min(rank))
    length = -F.col("best.less")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
