from __future__ import annotations

import hashlib
import random
import zlib

import cases
import numpy as np
import pytest

from callweave.llm import word_runs


def plain(ids, least=6, exponent=4):
    """Runs by comparing the words at every distance."""
    n, found = len(ids), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def told(doc, text):
    """The query's row of one document."""
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    digests = hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()
    head = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return doc, len(found), *head, *digests


@pytest.mark.parametrize("limits", [(6, 4), (2, 2), (5, 3), (9, 2)])
def test_runs_match_brute_force(limits):
    rnd = random.Random(limits[0])
    for _ in range(1500):
        n = rnd.randrange(0, 70)
        ids = [rnd.randrange(rnd.choice([1, 2, 3, 6])) for _ in range(n)]
        if rnd.random() < 0.6 and n:
            a = rnd.randrange(n)
            p = 1 + (n - a) // (3 + rnd.randrange(8))
            ids = ids[:a] + [ids[a + i % p] for i in range(n - a)]
        assert word_runs.runs(ids, *limits) == plain(ids, *limits)


def test_fibonacci_word_and_powers():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert word_runs.runs(b, 2, 2) == plain(b, 2, 2) and word_runs.runs(b, 2, 3) == plain(b, 2, 3)
    assert word_runs.runs([3] * 5000) == [(0, 5000, 1)]


def test_links_are_a_tree_of_suffixes():
    """Squares of the accesses are those of the definition: the last end of the longest strings of each segment."""
    rnd = random.Random(9)
    ids = [rnd.randrange(2) for _ in range(120)]
    for end, d, known in word_runs.squares(ids):
        assert d <= known and ids[end - known + 1 : end + 1] == ids[end - known + 1 - d : end + 1 - d]


def test_only_what_may_hold_a_run_is_appended():
    rnd = random.Random(2)
    ids = np.array([rnd.randrange(1000) for _ in range(20_000)])
    assert sum(b - a for a, b in word_runs.stretches(ids)) < 100
    ids[5000:5600] = np.tile(ids[5000:5100], 6)
    parts = word_runs.stretches(ids)
    assert any(a <= 5000 and b >= 5600 for a, b in parts) and sum(b - a for a, b in parts) < 1500


def documents():
    rnd = random.Random(6)
    rows = [(r[0], r[1]) for r in cases.documents()]
    rows += [(i, " ".join(rnd.choices("ab c\x0bd é".split(" "), k=rnd.randrange(0, 50)))) for i in range(1000, 1200)]
    return rows + [(4000 + i, cases.prose(200 + i, i)) for i in range(120)] + [(5000, "na " * 30_000), (5001, "  a a\x1c")]


def test_query_matches_brute_force(spark, tmp_path):
    rows = documents()
    spark.createDataFrame([r for r in rows if r[0] != 5000], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = word_runs.op13_word_runs(spark, str(tmp_path))
    assert dict(got.dtypes) == {n: "string" if n.endswith("256") else "bigint" for n in names}
    want = sorted((told(*r) for r in rows if r[0] != 5000), key=repr)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=repr) == want
    assert any(r[1] for r in want)


def test_collapse_keeps_columns_and_clean_texts(spark):
    docs = cases.with_extra(spark, [*cases.documents(), (5000, "na " * 30_000 + "end", "en", "a", 1)])
    got = word_runs.collapse(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[5000] == "na end" and texts[5] == "one  two\nthree "
    assert word_runs.periodic_runs(docs).filter("size(runs) = 1").count() >= 1


def test_empty_table(spark):
    none = cases.frame(spark, [])
    assert word_runs.periodic_runs(none).count() == 0 and word_runs.collapse(none).count() == 0
