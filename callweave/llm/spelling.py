"""Groups of spelling variants: near words found by depth-first search in a trie of letter-group counts.

Words are runs of letters up to U+00FF. Letters fall in `GROUPS` groups by code point; a word's frequency vector is its length and
its number of letters in each group. The trie arranges words by these numbers, one a level, so a leaf holds the words of one
vector. One replaced letter moves the vector by one surplus and one deficit at most, an inserted one by a single surplus. The search
walks down with a budget of one each: at a level it follows the equal count, the count above if the surplus is unspent, the count below
if the deficit is. Words of a leaf that is reached are verified letter by letter. Each pair is met from one side only: the shorter word
looks for the longer one; of equal lengths, the surplus must be spent before the deficit, and within one vector the smaller word looks.
The walk takes all words of a block at once: a step is one numpy lookup for those still on that branch.

At scale the upper trie is cut into subtrees. Nodes with more words than `block` are split further, level by level; they are
at most vocabulary / block of them a level, and `block` grows with the vocabulary so that these are no more than 2,048. This
directory of nodes goes to all tasks, which send every word to its own subtree and, as a searching word, to all that its budget
lets it reach. A leaf that is still too large is dealt out in blocks, and the searching words of a subtree in chunks, by bounds
from the directory: a task holds a block and a chunk, and no pair is lost.

Null texts have no words. A null identifier deletes nothing. Repeated rows count each. Two words of one count are taken in code-point order.
Empty tables give empty results; further columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.shared import alone, spread, table
from callweave.session import materialize

GROUPS = 16
LEAST_CHARS = 7
LEAST_COUNT = 2
RATIO = 10
BLOCK = 40_000
NODES = 2048
HELD_WORDS = 100_000
PAIRS = 1 << 16
TYPO = 31


def typed(word: str, start: int | None, rate: int = TYPO) -> str:
    """The word, or without one letter where the checksum from `start` over it is a multiple of `rate`."""
    if start is None:
        return word
    h = zlib.crc32(word.encode(), start)
    if h % rate:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def vocabulary(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, rate: int | None = None
) -> DataFrame:
    """word and n (occurrences) of the words that are long and frequent enough, counted inside the tasks first.

    With a `rate`, one letter is deleted from the words that the identifier's checksum picks.
    """
    letters = re.compile(f"[a-zÀ-ÿ]{{{least_chars},}}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        alone("spelling")
        for batch in batches:
            for name, value in zip(batch.column("name"), batch.column("text"), strict=True):
                words = letters.findall((value.as_py() or b"").lower().decode("utf-8", "replace"))
                if rate:
                    start = zlib.crc32(name.as_py() + b":") if name.is_valid else None
                    words = [t for w in words if len(t := typed(w, start, rate)) >= least_chars]
                seen.update(words)
                if len(seen) > HELD_WORDS:
                    yield _counts(seen)
                    seen.clear()
        yield _counts(seen)

    narrow = docs.select(F.col(doc_id).cast("string").cast("binary").alias("name"), F.col(text).cast("string").cast("binary").alias("text"))
    parts = spread(narrow).mapInArrow(counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _counts(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])


def vectors(words: list[bytes]) -> np.ndarray:
    """Length and letter-group counts of words in Latin-1, one row each."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), GROUPS + 1), np.int64)
    out[:, 0] = lengths
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        for part in np.array_split(at, 1 + len(at) * int(length) // (1 << 22)):
            groups = np.frombuffer(b"".join([words[i] for i in part]), np.uint8).reshape(len(part), length) % GROUPS
            for g in range(GROUPS):
                out[part, g + 1] = (groups == g).sum(axis=1)
    return out


class Trie:
    """Words by their vectors: per level the sorted (parent node, count) keys of the nodes; leaves hold spans of the words."""

    def __init__(self, words: list[bytes]):
        given = vectors(words)
        order = np.lexsort([np.array(words, object), *given.T[::-1]]) if len(words) else np.zeros(0, np.int64)
        self.words = [words[i] for i in order]
        rows = given[order]
        self.step = int(rows.max(initial=0)) + 3
        self.levels: list[np.ndarray] = []
        node = np.zeros(len(rows), np.int64)
        for level in range(GROUPS + 1):
            keys, node = np.unique(node * self.step + rows[:, level] + 1, return_inverse=True)
            self.levels.append(keys)
        self.starts = np.searchsorted(node, np.arange(len(self.levels[-1]) + 1))

    def child(self, level: int, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the nodes that have such a child, and the children."""
        keys = self.levels[level]
        wanted = node * self.step + count + 1
        at = np.searchsorted(keys, wanted)
        fits = (count >= 0) & (count + 2 < self.step) & (at < len(keys))
        fits[fits] = keys[at[fits]] == wanted[fits]
        found = np.flatnonzero(fits)
        return found, at[found]

    def search(self, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(row of `asked`, leaf, whether the vectors are equal) within the budget, by depth-first search."""
        everyone, root = np.arange(len(asked)), np.zeros(len(asked), np.int64)
        for more in (0, 1):  # length of the word looked for, over the asking one's
            found, node = self.child(0, root, asked[:, 0] + more)
            yield from self._walk(1, asked, everyone[found], node, 1, 1 - more)

    def _walk(self, level: int, asked: np.ndarray, row: np.ndarray, node: np.ndarray, surplus: int, deficit: int):
        """`surplus` and `deficit` are what may still be spent; a deficit is spent after the surplus only."""
        if not len(row):
            return
        if level > GROUPS:
            if surplus == deficit:
                yield row, node, surplus == 1
            return
        count = asked[row, level]
        for change in (0, 1, -1):
            if (change == 1 and not surplus) or (change == -1 and not (deficit and not surplus)):
                continue
            found, child = self.child(level, node, count + change)
            yield from self._walk(level + 1, asked, row[found], child, surplus - (change == 1), deficit - (change == -1))


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters `a` and `b`, `b` as long or one longer, differ by exactly one letter."""
    length = a.shape[1]
    front = a == b[:, :length]
    if b.shape[1] == length:
        return front.sum(axis=1) == length - 1
    back = (a == b[:, 1:])[:, ::-1]
    same = [np.where(m.all(axis=1), length, m.argmin(axis=1)) for m in (front, back)]
    return same[0] + same[1] >= length


def _product(starts: np.ndarray, sizes: np.ndarray, row: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of an asking row and each word of its leaf, some `PAIRS` at a time."""
    n = sizes[leaf]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    for low in range(0, total, PAIRS):
        at = np.arange(low, min(low + PAIRS, total))
        which = np.searchsorted(ends, at, side="right")
        yield row[which], starts[leaf[which]] + at - (ends[which] - n[which])


class Letters:
    """Words as one matrix of letters per length."""

    def __init__(self, words: list[bytes]):
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.row = np.zeros(len(words), np.int64)
        self.matrix: dict[int, np.ndarray] = {}
        for length in np.unique(self.length).tolist():
            at = np.flatnonzero(self.length == length)
            self.row[at] = np.arange(len(at))
            self.matrix[length] = np.frombuffer(b"".join([words[i] for i in at.tolist()]), np.uint8).reshape(len(at), length)


def near_pairs(held: list[bytes], asking: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (asking, held in the trie's order) of the near pairs that `asking` has to find."""
    trie = Trie(held)
    mine, theirs = Letters(asking), Letters(trie.words)
    sizes = np.diff(trie.starts)
    asked, of = np.unique(vectors(asking), axis=0, return_inverse=True)
    order = np.argsort(of.ravel(), kind="stable")
    firsts = np.searchsorted(of.ravel()[order], np.arange(len(asked) + 1))
    counts = np.diff(firsts)
    for row, leaf, equal in trie.search(asked):
        # one entry per asking word and leaf reached, then one per word of the leaf
        for leaf_at, position in _product(firsts, counts, np.arange(len(row)), row):
            word = order[position]
            for at, other in _product(trie.starts, sizes, np.arange(len(word)), leaf[leaf_at]):
                yield from _verified(mine, theirs, word[at], other, equal)


def _verified(mine: Letters, theirs: Letters, a: np.ndarray, b: np.ndarray, ordered: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The near ones of the pairs; with `ordered`, those whose first word is the smaller one."""
    lengths, more = mine.length[a], theirs.length[b[0]] - mine.length[a[0]]
    for length in np.unique(lengths).tolist():
        same = np.flatnonzero(lengths == length) if (lengths != length).any() else np.arange(len(a))
        for part in np.array_split(same, 1 + len(same) * length // (1 << 22)):
            x, y = mine.matrix[length][mine.row[a[part]]], theirs.matrix[length + more][theirs.row[b[part]]]
            hit = np.flatnonzero(near(x, y))
            if ordered and len(hit):
                differ = x[hit] != y[hit]
                place = np.arange(len(hit)), differ.argmax(axis=1)
                hit = hit[x[hit][place] < y[hit][place]]
            yield a[part[hit]], b[part[hit]]


class Directory:
    """The upper trie: the nodes that are split, and the subtrees below them with their blocks and chunks."""

    def __init__(self, split: dict[tuple, int], subtrees: dict[tuple, int], block: int):
        self.split, self.block = split, block
        self.parts: dict[tuple, tuple[int, int, int]] = {}  # prefix: first part, blocks, chunks
        first = 0
        for prefix, n in sorted(subtrees.items()):
            blocks, chunks = -(-n // block), -(-self._asking(prefix, subtrees) // (4 * block))
            self.parts[prefix] = first, blocks, chunks
            first += blocks * chunks

    def _asking(self, prefix: tuple, subtrees: dict) -> int:
        """No fewer words than those that search in a subtree."""
        total = 0
        for other in _within(prefix):
            n = self.split.get(other) or subtrees.get(other)
            total += n if n else self.block * any(other[:k] in subtrees for k in range(1, len(other)))
        return max(1, total)

    def home(self, vector: np.ndarray) -> tuple:
        """The subtree of a word."""
        for k in range(1, GROUPS + 2):
            if (prefix := tuple(vector[:k].tolist())) not in self.split or k == GROUPS + 1:
                return prefix

    def reached(self, vector: np.ndarray) -> Iterator[tuple]:
        """The subtrees in which a word has to look for near ones, by the same search."""
        waiting = [((int(vector[0]) + more,), 1, 1 - more) for more in (0, 1)]
        while waiting:
            prefix, surplus, deficit = waiting.pop()
            if prefix in self.parts:
                yield prefix
            elif prefix in self.split:
                count = int(vector[len(prefix)])
                waiting.append(((*prefix, count), surplus, deficit))
                if surplus:
                    waiting.append(((*prefix, count + 1), 0, deficit))
                elif deficit and count:
                    waiting.append(((*prefix, count - 1), surplus, 0))


def _within(prefix: tuple) -> Iterator[tuple]:
    """Prefixes of words that may search below `prefix`: one count less, or one less and a later one more."""
    tail = range(1, len(prefix))
    for shorter in (0, 1):
        base = (prefix[0] - shorter, *prefix[1:])
        yield base
        for i in tail:
            down = (*base[:i], base[i] - 1, *base[i + 1 :])
            yield down
            if not shorter:
                yield from ((*down[:j], down[j] + 1, *down[j + 1 :]) for j in tail if j > i)


def directory(placed: DataFrame, block: int | None = None) -> Directory:
    """Split the nodes of the trie level by level, from stored words with their `vector`."""
    total = placed.count()
    size = block or max(BLOCK, -(-total // NODES))
    split: dict[tuple, int] = {(): total}
    subtrees: dict[tuple, int] = {}
    parents = {(): total}
    for k in range(1, GROUPS + 2):
        prefix = F.slice("vector", 1, k)
        inside = placed
        if k > 1:  # words below the nodes that were split last, at most 2,048
            above = placed.sparkSession.createDataFrame([(list(p),) for p in parents], "above array<int>")
            inside = placed.join(above, F.slice("vector", 1, k - 1) == F.col("above"), "left_semi")
        counts = {tuple(r.prefix): r.n for r in inside.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n")).collect()}
        large = {p: n for p, n in counts.items() if n > size} if k <= GROUPS else {}
        subtrees |= {p: n for p, n in counts.items() if p not in large}
        split |= large
        parents = large
        if not large:
            break
    return Directory(split, subtrees, size)


def near_words(words: DataFrame, block: int | None = None) -> DataFrame:
    """word, n, other, other_n for every near word of every word (columns word: letters up to U+00FF, n), both ways."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            latin = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            rows = pa.array(list(vectors(latin).astype(np.int32)), pa.list_(pa.int32())) if latin else pa.array([], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), rows], ["word", "n", "vector"])

    placed = materialize(words.select("word", "n").mapInArrow(measured, "word string, n long, vector array<int>"))
    known = directory(placed, block)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach: dict[bytes, tuple] = {}
        for batch in batches:
            rows, parts, asks = [], [], []
            for row, (word, vector) in enumerate(zip(batch.column("word").to_pylist(), batch.column("vector"), strict=True)):
                counts = vector.values.to_numpy()
                spot = zlib.crc32(word.encode())
                if (key := counts.tobytes()) not in reach:
                    if len(reach) > HELD_WORDS:
                        reach.clear()
                    reach[key] = known.home(counts), tuple(known.reached(counts))
                home, asked = reach[key]
                first, blocks, chunks = known.parts[home]
                own = [first + spot % blocks * chunks + c for c in range(chunks)]
                others = []
                for prefix in asked:
                    first, blocks, chunks = known.parts[prefix]
                    others += [first + b * chunks + spot // blocks % chunks for b in range(blocks)]
                rows += [row] * (len(own) + len(others))
                parts += own + others
                asks += [False] * len(own) + [True] * len(others)
            at = pa.array(rows, pa.int32())
            columns = [pa.array(parts, pa.int64()), pa.array(asks, pa.bool_()), batch.column("word").take(at), batch.column("n").take(at)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "asks", "word", "n"])

    def met(group: pd.DataFrame) -> pd.DataFrame:
        alone("spelling")
        held = group[~group["asks"]]
        asking = group[group["asks"]]
        latin = [[w.encode("latin-1") for w in side["word"]] for side in (held, asking)]
        n_of = dict(zip(latin[0], held["n"].tolist(), strict=True))
        ordered = Trie(latin[0]).words if latin[0] else []
        found = list(near_pairs(*latin)) if latin[0] and latin[1] else []
        a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
        b = np.concatenate([y for _, y in found]) if found else np.zeros(0, np.int64)
        words, ns = asking["word"].to_numpy(object), asking["n"].to_numpy()
        other = [ordered[i] for i in b]
        return pd.DataFrame(
            {
                "word": pd.Series(words[a], dtype=object), "n": ns[a],
                "other": pd.Series([w.decode("latin-1") for w in other], dtype=object), "other_n": np.array([n_of[w] for w in other], np.int64),
            }
        )

    dealt = placed.mapInArrow(routed, "part long, asks boolean, word string, n long")
    pairs = dealt.groupBy("part").applyInPandas(met, "word string, n long, other string, other_n long")
    stored = materialize(pairs)
    turned = stored.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return stored.unionAll(turned)


def forms(words: DataFrame, ratio: int = RATIO, block: int | None = None) -> DataFrame:
    """word, n, n_near, form and form_n of every word: the most frequent near word, if it is `ratio` times as frequent."""
    stored = materialize(words.select("word", "n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best")
    told = near_words(stored, block).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    taken = -F.col("best.less") >= ratio * F.col("n")
    return stored.join(told, "word", "left").select(
        "word", "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("best.other")).alias("form"),
        F.when(taken, -F.col("best.less")).alias("form_n"),
    )


def rooted(found: DataFrame) -> DataFrame:
    """`found` with `root`, the end of the chain of forms; a chain of k forms is followed in log k joins.

    A form is at least twice as frequent as its word, so chains are short and have no rings.
    """
    stored = materialize(found)
    steps = stored.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = materialize(steps.join(on, "root", "left"))
        steps = joined.select("word", F.coalesce("next", "root").alias("root"))
        if joined.filter("next IS NOT NULL").isEmpty():
            return stored.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variant_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: int | None = None) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of a corpus."""
    return rooted(forms(vocabulary(docs, doc_id, text, rate=rate)))


def op12_spelling(spark, folder: str) -> DataFrame:
    found = variant_groups(table(spark, folder, "documents"), rate=TYPO)
    return found.select("word", "form", "root", "n", "n_near", "form_n")
