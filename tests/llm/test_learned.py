from __future__ import annotations

import itertools
import zlib

import cases
import numpy as np
import pytest
import zstandard

from callweave.llm import compression_quality, langid

EN = "the house and the garden with many trees where children play in summer until evening comes".split()
FR = "la maison avec le jardin et beaucoup de grands arbres où les enfants jouent pendant tout un été".split()


def two_languages(n=60):
    rng = np.random.default_rng(0)
    return [(i, " ".join(rng.choice(EN if i % 2 else FR, 40)), "en" if i % 2 else "fr", "s", 1) for i in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(cases.frame(spark, two_languages()), rounds=2)


def all_segmentations(word, index, probability):
    """Sum over every way to cut `word`, by listing the cuts."""
    total = np.zeros(probability.shape[1])
    for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, len(word)), k) for k in range(len(word))):
        parts = [word[a:b] for a, b in itertools.pairwise([0, *cuts, len(word)])]
        if all(p in index for p in parts):
            total += np.prod([probability[index[p]] for p in parts], axis=0)
    return total


def test_forward_sums_all_segmentations(model):
    index = langid.pieces(model.path)
    words = [b" garden", b" the", b" \xc3\xa9t\xc3\xa9", b" xqz", b"a"]
    got = langid.log_marginals(words, index, model.probability)
    for word, row in zip(words, got, strict=True):
        np.testing.assert_allclose(np.exp(row), all_segmentations(word, index, model.probability), rtol=1e-9)


def test_expected_counts_by_listing(model):
    index = langid.pieces(model.path)
    word, probability = b" the", model.probability
    got = langid.expected_counts([word], np.array([1]), np.array([3.0]), index, probability)
    want = np.zeros(len(index))
    total = all_segmentations(word, index, probability)[1]
    for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, 4), k) for k in range(4)):
        parts = [word[a:b] for a, b in itertools.pairwise([0, *cuts, 4])]
        if all(p in index for p in parts):
            for p in parts:
                want[index[p]] += 3 * np.prod([probability[index[q], 1] for q in parts]) / total
    np.testing.assert_allclose(got[:, 1], want, atol=1e-12)
    assert not got[:, 0].any()


def test_a_word_of_any_length_has_a_finite_likelihood(model):
    index = langid.pieces(model.path)
    long = langid.log_marginals([b"x" * 3000, b"x" * 1500], index, model.probability)
    assert np.isfinite(long).all()
    np.testing.assert_allclose(long[0] / long[1], 2, rtol=0.01)


def test_languages_of_awkward_rows(spark, model):
    rows = [*cases.documents(), (500, "the garden", None, None, 1), (501, "le jardin", None, None, 1), (502, "123 ½² Ⅷ ... 456", "en", "a", 1)]
    got = langid.predict(cases.with_extra(spark, rows), model)
    assert got.columns[-1] == "component_id" and got.count() == len(rows)
    by_id = {r.doc_id: (r.lang_pred, r.score) for r in got.collect()}
    assert by_id[500][0] == "en" and by_id[501][0] == "fr"
    assert by_id[1] == by_id[2] == by_id[3] == by_id[502] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in by_id.values())


def test_forgetting_changes_nothing(model, monkeypatch):
    text = [langid.words(" ".join(EN + FR)), langid.words("la la la"), langid.words(cases.prose(100, 3))]
    whole = [langid.Scorer(model).predict(t) for t in text]
    monkeypatch.setattr(langid, "REMEMBERED", 7)
    scorer = langid.Scorer(model)
    scorer.prefetch(text)
    for (a, x), (b, y) in zip(whole, [scorer.predict(t) for t in text], strict=True):
        assert a == b and x == pytest.approx(y)


def test_nothing_learned(spark):
    none = langid.fit(cases.frame(spark, []))
    assert none.languages == ()
    got = langid.predict(cases.frame(spark), none).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in got] == [("und", 0.0)]
    assert langid.predict(cases.frame(spark, []), none).count() == 0


def test_held_out_folds(spark):
    ids = spark.range(50).withColumnRenamed("id", "doc_id")
    for module, folds, fold in ((langid, 4, 2), (compression_quality, 5, 0)):
        for r in ids.withColumn("h", module.held_out(ids.doc_id)).collect():
            assert r.h == (zlib.crc32(str(r.doc_id).encode()) % folds == fold)


@pytest.mark.parametrize("name", ["lang", "quality"])
def test_held_out_accuracy(spark, name):
    folder = "/root/testdata/sf0.01"
    if name == "lang":
        got = langid.op4_language_id(spark, folder)
        truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
        right, least = got.lang_pred == truth.lang, 0.99
    else:
        got = compression_quality.op3_compression_quality(spark, folder)
        truth = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
        right, least = got.predicted == truth.quality, 0.93
    both = got.join(truth, "doc_id").filter("held_out").withColumn("right", right)
    assert both.agg({"right": "count"}).first()[0] > 50
    assert both.filter("right").count() / both.count() >= least
    assert got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def quality_rows(n=80):
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        docs.append((i, cases.prose(150, i) if good else " ".join(f"{w}$$$ |" for w in rng.choice(EN, 120)), "en", "a", 1))
        labels.append((i, int(good), 0))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


def test_quality_separates(spark):
    docs, labels = quality_rows()
    frame = cases.frame(spark, docs)
    model = compression_quality.fit(frame, spark.createDataFrame(labels, LABELS))
    scored = {r.doc_id: r.score for r in compression_quality.score(frame, model).collect()}
    good = [scored[i] for i, q, _ in labels if q]
    bad = [scored[i] for i, q, _ in labels if not q]
    assert min(good) > max(bad)


def test_quality_of_awkward_rows(spark):
    docs, labels = quality_rows(40)
    labels += [(None, 1, 0), (3, None, 0), (5, 1, 0), (5, 1, 0), (99_999, 0, 0)]
    known = spark.createDataFrame(labels, LABELS)
    model = compression_quality.fit(cases.with_extra(spark, docs + cases.documents()), known)
    got = compression_quality.score(cases.with_extra(spark), model)
    assert got.count() == len(cases.documents())
    rows = got.collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1


@pytest.mark.parametrize(("labels", "want"), [([], 0.5), ([(1, 1, 0), (2, 1, 0)], 0.999), ([(1, 0, 0)], 0.001)])
def test_quality_without_both_labels(spark, labels, want):
    docs = cases.frame(spark, [(1, "some text", "en", "a", 1), (2, "other", "en", "a", 1)])
    model = compression_quality.fit(docs, spark.createDataFrame(labels, LABELS))
    assert [r.score for r in compression_quality.score(docs, model).collect()] == [pytest.approx(want)] * 2
    assert compression_quality.score(cases.frame(spark, []), model).count() == 0


def test_difference_counts_all_segments():
    samples = [cases.prose(150, i).encode() for i in range(200)]
    pair = compression_quality.Dictionaries(compression_quality.train(samples), b"", "k")
    text = cases.prose(2000, 3).encode()
    made = compression_quality.Compressors(pair)
    plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False)
    cut = [text[i : i + 1000] for i in range(0, len(text), 1000)]
    want = sum(len(plain.compress(s)) - len(made.good.compress(s)) for s in cut) / len(text)
    assert made.difference(text) == pytest.approx(want) and want > 0


def test_noise_does_not_flatten_the_curve():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(-1, 0.2, 300), rng.normal(1, 0.2, 700)])
    y = (x > 0).astype(float)
    wrong = rng.random(1000) < 0.03
    weights, noise = compression_quality.noisy_logistic(x[:, None], np.where(wrong, 1 - y, y))
    flat = compression_quality.logistic(x[:, None], np.where(wrong, 1 - y, y))
    assert weights[0] > 1.5 * flat[0] and 0.01 < noise < 0.06


def test_very_long_words_are_trained_on():
    """Expected pieces of words far beyond the range of floating point add up to their bytes."""
    index = {b" ": 0, b"a": 1, b"b": 2, b"ab": 3, b" a": 4}
    probability = np.array([[0.1, 0.2], [1e-4, 0.2], [1e-4, 0.2], [1e-5, 0.2], [0.1, 0.2]])
    coded = [b" " + b"ab" * 2_000, b" " + b"a" * 3_000]
    sums = langid.expected_counts(coded, np.array([0, 1]), np.array([1.0, 2.0]), index, probability)
    width = np.array([1, 1, 1, 2, 2])
    assert np.allclose(width @ sums, [4_001, 2 * 3_001])
    assert sums[3, 0] > 1_900 and sums[3, 1] == 0
