from __future__ import annotations

import hashlib
import re
from collections import Counter

import cases
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from callweave.llm import byte_bpe, exact_dedup, mixing, simhash
from callweave.session import materialize


def outputs(spark, docs):
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, "unused"))
        out.append(docs)
    return out


@pytest.fixture(scope="module")
def stages(spark):
    return outputs(spark, cases.with_extra(spark))


def test_names_and_columns(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "near dedup", "mixing sources", "byte BPE"]
    for out in stages[:-1]:
        assert out.columns == cases.with_extra(spark).columns
    assert {"doc_id", "n_tokens"} <= set(stages[-1].columns)


def test_each_stage_by_brute_force(stages):
    language, exact, near, mix, tokens = ([r.asDict() for r in s.collect()] for s in stages)
    assert Counter(r["doc_id"] for r in language) == Counter(r[0] for r in cases.documents() if r[1] and re.search(r"[^\W\d_]", r[1]))

    def bare(text):
        return re.sub(r"[\x20\x09-\x0d]+", "", text)

    assert len(exact) == len({bare(r["text"]) for r in language}) == len({bare(r["text"]) for r in exact})
    prints = {}
    for r in exact:
        prints.setdefault(simhash.fingerprint(r["text"].encode()) % 2**64, []).append(r["doc_id"])
    left = set(prints)
    groups = 0
    while left:
        queue = [left.pop()]
        groups += 1
        while queue:
            p = queue.pop()
            near_by = {q for q in left if (p ^ q).bit_count() <= 4}
            left -= near_by
            queue += near_by
    assert len(near) == groups < len(exact)
    emitted = Counter(r["doc_id"] for r in mix)
    assert set(emitted) <= {r["doc_id"] for r in near} and max(emitted.values()) <= 3
    texts = {r["doc_id"]: r["text"] for r in mix}
    assert Counter(r["doc_id"] for r in tokens) == emitted
    digest = next(c for c in tokens[0] if c.endswith("decoded_sha256"))
    for r in tokens:
        assert r[digest] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_stages_agree_with_their_operators(spark, stages):
    want = Counter(r.doc_id for r in mixing.mix(stages[2]).collect())
    assert Counter(r.doc_id for r in stages[3].collect()) == want
    assert exact_dedup.deduplicate(stages[1]).count() == stages[1].count()
    assert simhash.deduplicate(stages[2]).count() == stages[2].count()
    assert byte_bpe.encode(stages[3]).count() == stages[4].count()


def test_empty_table(spark):
    assert [s.count() for s in outputs(spark, cases.frame(spark, []))] == [0] * 5


def test_registered(spark):
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if re.match(r"op\d+_", k)}
    assert "pipeline" in names
    assert names["pipeline"](spark, "/root/testdata/sf0.001").count() > 50
