from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import cases
import numpy as np
import pytest

from callweave.llm import spelling


def plain_words(rows):
    """Occurrences of the words of the query, letter by letter."""
    seen = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode()) if doc is not None else 1
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words):
    """The query's rows from the words, every pair compared."""
    out = {}
    for w, n in words.items():
        close = [o for o in words if o != w and is_near(w, o)]
        best = min(close, key=lambda o: (-words[o], o.encode()), default=None)
        out[w] = best if best is not None and words[best] >= 10 * n else None, len(close), n
    rows = set()
    for w, (form, n_near, n) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, n, n_near, None if form is None else words[form]))
    return rows


def texts(seed, stems=30):
    """Words with variants of falling frequency, so that forms make chains."""
    rnd = random.Random(seed)
    letters = "abcdefghilmnoprstuéßÀ÷"
    rows = []
    for k in range(stems):
        word = "".join(rnd.choices(letters, k=rnd.randrange(6, 12)))
        times = 300
        while times >= 1:
            rows += [(rnd.choice([i, None]), f"{word} {word.upper() if word.isascii() else word}-{word}1{word}") for i in range(k, k + times)]
            at = rnd.randrange(len(word))
            word = rnd.choice([word[:at] + word[at + 1 :], word[:at] + rnd.choice(letters) + word[at:], word[:at] + rnd.choice(letters) + word[at + 1 :]])
            times //= rnd.choice([2, 12, 20])
    return rows


def test_query_matches_brute_force(spark, tmp_path):
    rows = texts(1) + [(r[0], r[1]) for r in cases.documents()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = spelling.op12_spelling(spark, str(tmp_path))
    want = plain(plain_words(rows))
    assert any(r[2] not in (r[0], r[1]) for r in want)
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == want


@pytest.mark.parametrize(("alphabet", "length", "block"), [("ab", 9, 7), ("abcdefghijklmnop", 7, 25), ("aq", 8, 300), ("aàb\xff", 7, 40)])
def test_small_blocks_lose_no_pair(spark, alphabet, length, block):
    """Subtrees of all depths, leaves in blocks and words in chunks; letters of one group (a, q) leave the vectors equal."""
    rnd = random.Random(block)
    words = sorted({"".join(rnd.choices(alphabet, k=length + rnd.randrange(3))) for _ in range(220)})
    frame = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    got = [(r.word, r.n, r.other, r.other_n) for r in spelling.near_words(frame, block).collect()]
    n = {w: i + 1 for i, w in enumerate(words)}
    want = {(a, n[a], b, n[b]) for a in words for b in words if a != b and is_near(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_one_walk_finds_each_pair_once():
    rnd = random.Random(4)
    words = sorted({"".join(rnd.choices("abcde", k=rnd.randrange(7, 10))).encode() for _ in range(900)})
    held = spelling.Trie(words).words
    found = [(words[i], held[j]) for a, b in spelling.near_pairs(words, words) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    want = {frozenset((a, b)) for a in words for b in words if a != b and is_near(a.decode(), b.decode())}
    assert len(found) == len(want) and {frozenset(p) for p in found} == want


def test_very_long_words_and_no_words(spark):
    long = "x" * 70_000
    frame = spark.createDataFrame([(long, 50), (long + "y", 2), (long[:-1], 3)], "word string, n long")
    got = {(len(r.word), len(r.other)) for r in spelling.near_words(frame).collect()}
    assert got == {(70_000, 70_001), (70_001, 70_000), (70_000, 69_999), (69_999, 70_000)}
    assert spelling.variant_groups(cases.frame(spark, [])).count() == 0
    assert len(spelling.vectors([])) == 0 and np.array_equal(spelling.vectors([b"ab"])[0][:1], [2])


def test_further_columns_are_ignored(spark):
    got = spelling.variant_groups(cases.with_extra(spark))
    assert set(got.columns) == {"word", "form", "root", "n", "n_near", "form_n"}
