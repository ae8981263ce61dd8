from __future__ import annotations

import cases
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from callweave.llm import components as steps
from callweave.llm import simhash
from callweave.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest identifier per fingerprint component, by brute force."""
    distinct = sorted(set(prints.values()))
    parent = {p: p for p in distinct}

    def top(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[top(b)] = top(a)
    least = {}
    for doc, p in prints.items():
        least[top(p)] = min(doc, least.get(top(p), doc))
    return {doc: least[top(p)] for doc, p in prints.items()}


def test_the_code_is_perfect():
    rest, _ = simhash._golay()
    words = np.random.default_rng(0).integers(0, 1 << 23, 20_000)
    index = simhash.decode(words)
    codewords = (index << 11) | rest[index]
    assert (np.bitwise_count(codewords ^ words) <= 3).all()
    assert len(np.unique((np.arange(4096) << 11) | rest)) == 4096


def test_keys_meet_within_four_bits():
    rng = np.random.default_rng(1)
    a = rng.integers(-(2**63), 2**63 - 1, 3000)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, i % 5, replace=False):
            b[i] ^= np.int64(simhash._signed(1 << int(bit)))
    keys = []
    for side in (a, b):
        rows, found = simhash.fuzzy_keys(side)
        keys.append([set() for _ in side])
        for row, key in zip(rows, found, strict=True):
            keys[-1][row].add(key)
    assert all(x & y for x, y in zip(*keys, strict=True))


def test_query_matches_brute_force(spark):
    rows = [r for r in cases.documents() if r[0] is not None]
    prints = {r[0]: plain_fingerprint(r[1]) for r in rows}
    want = plain_components(prints)
    got = simhash.groups(cases.with_extra(spark)).collect()
    assert len(got) == len(cases.documents())
    for r in got:
        if r.doc_id is not None:
            assert r["print"] % 2**64 == prints[r.doc_id]
            assert r.component_id == want[r.doc_id]
    assert len({want[k] for k in range(100, 140)}) < 40


def test_chains_of_links(spark):
    """Neighbours in the chain are linked, its ends are far apart."""
    values, at = [], 0
    for step in range(12):
        values.append(at)
        for bit in range(4):
            at |= 1 << (step * 4 + bit)
    rows = [(simhash._signed(v), 50 - i) for i, v in enumerate(values)]
    prints = spark.createDataFrame(rows, "print long, node long")
    links = simhash.links(prints)
    assert links.count() == 11
    assert {r.root for r in components(links).collect()} == {39}


@pytest.mark.parametrize("seed", range(2))
def test_components_match_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 240)]
    parent = {}

    def top(p):
        parent.setdefault(p, p)
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    want = {p: top(p) for p in parent if top(p) != p}
    got = components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == want


def test_a_null_identifier_is_a_bridge(spark, monkeypatch):
    """Fingerprints 0, 15 and 255: the middle one has no identifier and links the other two."""
    monkeypatch.setattr(simhash, "fingerprints", lambda text, *_: text.cast("long"))
    rows = [(9, "255"), (None, "15"), (5, "0"), (None, "1048575"), (7, "-1"), (7, "4398046511103")]
    got = simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r["print"]): r.component_id for r in got} == {
        (9, 255): 5, (None, 15): 5, (5, 0): 5, (None, 1048575): None, (7, -1): 7, (7, 4398046511103): 7,
    }


def test_deduplicate(spark):
    docs = cases.with_extra(spark)
    got = simhash.deduplicate(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    ids = [r.doc_id for r in rows]
    assert ids.count(9) == 1 and 4 in ids and 5 not in ids and 1 in ids and 2 not in ids
    again = {r.doc_id: r.component_id for r in simhash.groups(docs.filter("doc_id is not null")).collect()}
    assert all(i is None or again[i] == i for i in ids)


def test_empty_table(spark):
    none = cases.frame(spark, [])
    assert simhash.groups(none).count() == 0
    assert simhash.deduplicate(none).columns == none.columns


def test_links_beyond_the_keys_are_refused(spark):
    with pytest.raises(ValueError, match="4 bits"):
        simhash.links(spark.createDataFrame([], "print long, node long"), 5)


def test_native_hash_is_the_same(spark):
    text = "one two three four"
    native = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
    assert native % 2**64 == xxhash.xxh64_intdigest(text.encode(), 42)


def test_a_group_of_near_copies_makes_few_links(spark, monkeypatch):
    """Fingerprints of four bits of thirty, of which one pair in fourteen or so is linked, beside some that are far from all."""
    rnd = np.random.default_rng(4)
    prints = sorted({sum(1 << int(b) for b in rnd.choice(30, 4, replace=False)) for _ in range(1200)} | {int(v) for v in rnd.integers(1 << 60, 1 << 62, 50)})
    rows = [(str(p), i) for i, p in enumerate(prints)]
    links = sum((a ^ b).bit_count() <= 4 for i, a in enumerate(prints) for b in prints[:i])
    seen = []
    star = steps._large_star
    monkeypatch.setattr(steps, "_large_star", lambda edges: (seen.append(edges.count()), star(edges))[1])
    monkeypatch.setattr(simhash, "fingerprints", lambda text, *_: text.cast("long"))
    got = simhash.groups(spark.createDataFrame(rows, "text string, doc_id long")).collect()
    want = plain_components({i: p for i, p in enumerate(prints)})
    assert {r.doc_id: r.component_id for r in got} == want
    assert links > 30 * len(prints)
    assert max(seen) < 15 * len(prints)
