from __future__ import annotations

import cases
import numpy as np

import corpus_pipeline
from callweave.llm import shingle_dedup, simhash
from callweave.llm.components import components


def edited(text, places):
    words = text.split()
    for p in places:
        words[p] = f"new{p}"
    return " ".join(words)


def plain_jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def texts():
    """Bases of 60 to 300 words, each with copies on both sides of the limit."""
    rows = []
    for k in range(30):
        n = 60 + 8 * k
        base = cases.prose(n, 500 + k)
        rows += [base] + [edited(base, range(3, 3 + step * count, step)) for step, count in ((5, 2), (9, n // 60), (9, n // 30), (7, n // 12))]
    return rows


def plain_groups(rows):
    prints = [simhash.fingerprint(t.encode()) % 2**64 for t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(rows):
        for j in range(i):
            if label[i] != label[j] and ((prints[i] ^ prints[j]).bit_count() <= 4 or plain_jaccard(a, rows[j]) >= 0.8):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def test_near_copies_beyond_four_bits_are_found(spark):
    rows = texts()
    far = [(a, b) for i, a in enumerate(rows) for b in rows[:i] if plain_jaccard(a, b) >= 0.8 and (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count() > 4]
    assert len(far) > 20
    want = plain_groups(rows)
    docs = cases.with_extra(spark, [(i, t, "en", "a", 1) for i, t in enumerate(rows)])
    got = corpus_pipeline.without_near_copies(spark, docs, "unused")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want))
    assert len(set(want)) < simhash.deduplicate(docs).count() < len(rows)


def test_coefficient_and_keys():
    rows = texts()
    sets = [shingle_dedup.shingles(t.encode()) for t in rows]
    keys = [shingle_dedup.band_keys(s) for s in sets]
    for i in range(len(rows)):
        for j in range(i):
            dice = plain_jaccard(rows[i], rows[j])
            assert shingle_dedup.jaccard(sets[i], sets[j]) == dice
            if dice >= 0.8:
                assert np.any(keys[i] == keys[j])


def test_short_null_and_repeated_rows(spark):
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "One two", "en", "a", 0), (4, "one  two", "en", "a", 0), (5, "two one", "en", "a", 0), (None, "two one", "en", "a", 0), (5, "two one", "en", "a", 0)]
    got = shingle_dedup.deduplicate(cases.frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == [1, 3, 5]
    assert shingle_dedup.deduplicate(cases.frame(spark, [])).count() == 0


def test_odd_sketches_never_lose_a_link(spark):
    """What the sketches reject is below the limit, over sets of unlike sizes, and most of what is far below is rejected."""
    rnd = np.random.default_rng(0)
    rows = []
    for i in range(400):
        n = int(rnd.integers(1, 700))
        base = rnd.integers(0, 1 << 63, n).astype(np.uint64)
        other = np.concatenate([base[rnd.random(n) < rnd.choice([1, 0.97, 0.9, 0.8, 0.5])], rnd.integers(0, 1 << 63, int(n * rnd.choice([0, 0.03, 0.1, 0.3]))).astype(np.uint64)])
        a, b = np.unique(base), np.unique(other)
        if len(b):
            both = len(np.intersect1d(a, b))
            rows.append((i, both / (len(a) + len(b) - both), len(a), shingle_dedup.odd_sketch(a).tolist(), len(b), shingle_dedup.odd_sketch(b).tolist()))
    pairs = spark.createDataFrame(rows, "i int, j double, size_a int, odd_a array<long>, size_b int, odd_b array<long>")
    got = pairs.select("j", shingle_dedup.possible(0.8).alias("stays")).collect()
    assert all(r.stays for r in got if r.j >= 0.8) and any(r.j >= 0.8 for r in got)
    low = [r.stays for r in got if r.j < 0.6]
    assert len(low) > 50 and sum(low) < 0.1 * len(low)


def test_a_bucket_of_unlike_near_copies_makes_few_rows(spark, monkeypatch):
    """Seven hundred texts at about 0.6 of each other: their pairs end in the join condition."""
    base = cases.prose(200, 9)
    rnd = np.random.default_rng(1)
    rows = [(i, edited(base, [int(p) for p in rnd.choice(200, 8, replace=False)]).replace("new", f"new{i}x")) for i in range(700)]
    seen = []
    verified = shingle_dedup.verified
    monkeypatch.setattr(shingle_dedup, "verified", lambda pairs, *a: (seen.append(pairs.count()), verified(pairs, *a))[1])
    texts = spark.createDataFrame(rows, "node long, text string")
    found = shingle_dedup.links(texts).count()
    assert sum(seen) < 3 * len(rows) and found <= sum(seen)
    near = [i for i in range(0, 700, 50) if plain_jaccard(rows[i][1], rows[0][1]) >= 0.8]
    assert near == [0]


def test_a_group_of_loosely_linked_copies_makes_few_rows(spark, monkeypatch):
    """Nine hundred texts of which one pair in fifty or so is linked: rows that are compared grow with the texts, not with their pairs."""
    base = cases.prose(200, 12)
    rnd = np.random.default_rng(3)
    rows = [edited(base, sorted(int(p) for p in rnd.choice(np.arange(0, 180, 3), 4, replace=False))) for _ in range(900)]
    sets = [set(shingle_dedup.shingles(t.encode()).tolist()) for t in rows]
    label, pairs = list(range(len(rows))), 0
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= 0.8 * (len(a) + len(sets[j]) - both):
                pairs += 1
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label] if low < high else label
    seen = []
    verified = shingle_dedup.verified
    monkeypatch.setattr(shingle_dedup, "verified", lambda met, *a: (seen.append(met.count()), verified(met, *a))[1])
    found = components(shingle_dedup.links(spark.createDataFrame(list(enumerate(rows)), "node long, text string")))
    assert {r.node: r.root for r in found.collect()} == {i: x for i, x in enumerate(label) if i != x}
    assert pairs > 8 * len(rows)
    assert sum(seen) < 8 * len(rows)
