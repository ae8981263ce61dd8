from __future__ import annotations

import hashlib
import random

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least_chars=20, least_docs=3):
    """(doc_id, lines, dropped, kept text) of every row, by a table of all keys; null identifiers are the smallest document."""
    where = {}
    rank = lambda i: (i is not None, i or 0)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(SPACE).translate(LOWER)
            if len(key) >= least_chars:
                where.setdefault(key, set()).add(rank(doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        left = []
        for line in lines:
            docs = where.get(line.strip(SPACE).translate(LOWER), ())
            if len(docs) < least_docs or max(docs) == rank(doc):
                left.append(line)
        out.append((doc, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def told(rows, **kw):
    return sorted(((d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in plain(rows, **kw)), key=repr)


def shared_lines(seed, docs=300):
    rnd = random.Random(seed)
    pool = [f"shared line number {k} of the pool" for k in range(12)] + ["short one", "ÄÖÜ äöü line, long enough", "İ dotted capital, long enough"]
    rows = []
    for i in range(docs):
        lines = [rnd.choice(pool) if rnd.random() < 0.5 else f"own line {i} {k} that nobody else has" for k in range(rnd.randrange(0, 9))]
        lines = [rnd.choice(["", " ", "\t"]) + (x.upper() if x.isascii() and rnd.random() < 0.3 else x) + rnd.choice(["", "\r", "  "]) for x in lines]
        rows.append((rnd.choice([i, i, i, None, 7]), rnd.choice(["\n".join(lines)] * 9 + [None])))
    return rows + [(500 + k, "a line that stands everywhere\nend " + str(k)) for k in range(200)]


@pytest.mark.parametrize("seed", range(2))
def test_query_matches_brute_force(spark, tmp_path, seed):
    rows = shared_lines(seed) + [(r[0], r[1]) for r in cases.documents()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in line_dedup.op11_line_dedup(spark, str(tmp_path)).collect()), key=repr)
    assert got == told(rows)


def test_a_key_may_span_ranges(spark):
    """Twelve ranges for two keys: the edges of the ranges are settled by their counts."""
    rows = [(i, "the very common line of this test\nthe other common line of this test\n" + str(i % 3)) for i in range(400)]
    rows += [(1000, "twice is not enough for this line"), (1001, "twice is not enough for this line")]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        maps = line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string"))
        got = {r.doc_id: (r.n_lines, r.n_dropped) for r in maps.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert got == {i: (3, 2) for i in range(399)}


@pytest.mark.parametrize("least_docs", [2, 4])
def test_other_limits(spark, least_docs):
    rows = [(k, f"line {j} of some documents" + "\n" + "tiny") for j in range(1, 6) for k in range(j * 10, j * 10 + j)]
    got = line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string"), least_docs=least_docs)
    want = sum(d for _, _, d, _ in plain(rows, least_docs=least_docs))
    assert got.agg(F.sum("n_dropped")).first()[0] == want


def test_deduplicate_keeps_columns(spark):
    rows = [(i, "a common line of many characters\nrest", "en", "a", 1) for i in range(5)] + cases.documents()
    docs = cases.with_extra(spark, rows)
    got = line_dedup.deduplicate(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[0] == "rest" and texts[3] != "" and texts[100] is not None
    assert got.filter("doc_id = 4 and text like 'a common%'").count() == docs.filter("doc_id = 4 and text like 'a common%'").count()
    nulls = docs.filter("text is null").count()
    assert got.filter("text is null").count() == nulls


def test_empty_table(spark):
    none = cases.frame(spark, [])
    assert line_dedup.keep_bitmaps(none).count() == 0
    assert line_dedup.deduplicate(none).columns == none.columns


def test_bitmaps_are_small():
    bitmap = line_dedup.packed(100_000, np.arange(10, 50_000))
    assert len(bitmap) < 200
    n, gone, left = line_dedup.kept_lines(b"x\n" * 99_999, bitmap)
    assert (n, gone) == (100_000, 49_990) and left.count(b"\n") == 50_009
