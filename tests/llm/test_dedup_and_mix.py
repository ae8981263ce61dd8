from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import cases
import duckdb
import pytest

from callweave.llm import exact_dedup, mixing


def bare(text):
    return re.sub(r"[\x20\x09-\x0d]+", "", text or "")


@pytest.mark.parametrize(("runs", "fan_in"), [(16, 4), (1, 4), (8, 2)])
def test_groups_match_brute_force(spark, runs, fan_in):
    rows = cases.documents()
    got = exact_dedup.groups(cases.with_extra(spark), runs=runs, fan_in=fan_in).collect()
    assert len(got) == len(rows)
    members = defaultdict(list)
    for doc_id, text, *_ in rows:
        members[bare(text)].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    want = Counter()
    for key, group in members.items():
        keep = min(group, key=lambda m: m[:3])
        sha = hashlib.sha256(key.encode()).hexdigest()
        kept_seen = False
        for m in sorted(group, key=lambda m: m[:3]):
            want[m[3], keep[3], len(group), not kept_seen, sha] += 1
            kept_seen = True
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_deduplicate_keeps_one_row_and_all_columns(spark):
    docs = cases.with_extra(spark)
    got = exact_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert len({bare(r.text) for r in rows}) == len(rows) == len({bare(r[1]) for r in cases.documents()})
    assert sum(r.doc_id == 9 for r in rows) == 1


def test_empty_tables(spark):
    none = cases.frame(spark, [])
    assert exact_dedup.groups(none).count() == 0
    assert exact_dedup.deduplicate(none).columns == none.columns
    assert mixing.taken(none).count() == 0
    assert mixing.mix(none).count() == 0


def oracle(rows, sql, kinds):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents ({kinds})")
    con.executemany(f"INSERT INTO documents VALUES ({', '.join('?' * len(rows[0]))})", rows)
    return Counter(tuple(r) for r in con.execute(sql).fetchall())


def test_mix_matches_sql_on_awkward_rows(spark):
    rows = cases.documents()
    got = Counter(tuple(r) for r in mixing.taken(cases.with_extra(spark)).collect())
    want = oracle(rows, mixing.ORACLE, "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT")
    assert got == want


def by_rounds(sizes, weights, cap):
    """Targets by resharing the excess round after round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > cap * sizes[s]}
        if not over:
            target.update({s: left * weight[s] / total for s in free})
            break
        for s in over:
            target[s] = float(cap * sizes[s])
        left -= sum(target[s] for s in over)
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 40}, {"x": 0, "y": 7}, {"z": 0}, {"b": 3, "a": 3, "": 300, "d": 1}])
def test_targets_are_the_fixed_point_of_resharing(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = by_rounds(sizes, mixing.WEIGHTS, mixing.CAP)
    assert got == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    rows = [(i, cases.prose(20 + i % 50, i), "en", f"s{i % 7 if i % 3 else 0}", 1) for i in range(900)]
    docs = cases.frame(spark, rows)
    first, second = mixing.taken(docs).collect(), mixing.taken(docs.repartition(5)).collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, second))
    taken, target = Counter(), {}
    source = {r[0]: r[3] for r in rows}
    for r in first:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken <= 3 * r.size
    for s, t in target.items():
        assert abs(taken[s] - t) < 0.02 * t + 70
    emitted = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert all(emitted[r.doc_id] * r.size == r.taken for r in first)


def test_mix_passes_clashing_columns_through(spark):
    docs = cases.with_extra(spark).withColumnRenamed("kept", "whole").withColumnRenamed("print", "seed")
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    assert {r.whole for r in got.collect()} == {"kept"}
