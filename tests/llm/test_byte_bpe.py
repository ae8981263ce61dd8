from __future__ import annotations

import base64
import hashlib
import random

import cases
import public_tokenizers
import pytest
import tiktoken

from callweave.llm import byte_bpe

ODD = ["", "'s don't 'LL", "a  b\n\n c\t", "  ", "漢字かな交じり文", "🙂👩‍👩‍👧é", "\x00\x1c\x1f\x85\xa0", "<|endoftext|>", "x" * 5000, "1234567890 ½ ²"]


@pytest.fixture(scope="module")
def reference():
    lines = open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.loaded(public_tokenizers.path(byte_bpe.VOCABULARY), public_tokenizers.PATTERN)


def test_ids_on_odd_texts(reference, bpe):
    rnd = random.Random(3)
    letters = "aàé 漢字🙂́‍\n\t '1234sdt\xa0"
    texts = ODD + ["".join(rnd.choices(letters, k=rnd.randint(0, 60))) for _ in range(3000)]
    for text in texts:
        ids = list(bpe.encode(text))
        assert ids == reference.encode_ordinary(text)
        assert byte_bpe.decoded(ids, byte_bpe.token_bytes(public_tokenizers.path(byte_bpe.VOCABULARY))) == text.encode()


def test_every_character(reference, bpe):
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000] + list(range(0xE0000, 0xE0200))
    for at in range(0, len(points), 50):
        text = "".join(f"a{chr(c)}b {chr(c)}1\n{chr(c)}" for c in points[at : at + 50])
        assert list(bpe.encode(text)) == reference.encode_ordinary(text)


def test_forgetting_changes_nothing(reference, bpe, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 10)
    text = cases.prose(300, 9)
    assert list(bpe.encode(text)) == reference.encode_ordinary(text)
    assert len(bpe.known) <= len(set(text.split())) + 1
    assert list(bpe.encode(text + " again")) == reference.encode_ordinary(text + " again")


def test_query_digests(spark, reference):
    rows = [*cases.documents(), *[(1000 + i, t, None, None, 0) for i, t in enumerate(ODD)]]
    got = byte_bpe.digests(byte_bpe.encode(cases.with_extra(spark, rows))).collect()
    assert len(got) == len(rows)
    want = {}
    for doc_id, text, *_ in rows:
        ids = reference.encode_ordinary(text or "")
        joined = ",".join(map(str, ids)).encode()
        want.setdefault(doc_id, set()).add((len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) in want[r.doc_id]
        assert r.kept == "kept"


def test_offsets_cover_characters(spark):
    df = spark.createDataFrame([("héllo 漢 🙂",)], "text string")
    row = byte_bpe.encode(df.withColumn("copy", df.text), offsets="spans").first()
    assert len(row.ids) == len(row.spans)
    covered = set()
    for start, end in row.spans:
        assert 0 <= start < end <= len(row.copy)
        covered.update(range(start, end))
    assert covered == set(range(len(row.copy)))


def test_slices_decode_to_parts_of_characters(spark, bpe):
    ids = list(bpe.encode("🙂"))
    assert len(ids) > 1
    df = spark.createDataFrame([(1, ids), (2, ids[:1]), (3, None), (4, [ids[0], None, *ids[1:]]), (5, [])], "k int, ids array<int>")
    known = byte_bpe.token_bytes(public_tokenizers.path(byte_bpe.VOCABULARY))
    assert {r.k: bytes(r.bytes) for r in byte_bpe.decode(df).collect()}[2] == known[ids[0]]
    assert {r.k: r.text for r in byte_bpe.decode_text(df).collect()} == {1: "🙂", 2: "�", 3: "", 4: "🙂", 5: ""}


def test_empty_table(spark):
    none = cases.frame(spark, [])
    assert byte_bpe.digests(byte_bpe.encode(none)).collect() == []
