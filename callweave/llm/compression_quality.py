"""Quality scores from how well a text compresses with dictionaries of good and of bad text.

Two zstandard dictionaries are trained, one on good and one on bad labelled text. A whole text is cut into segments, every
segment is compressed with either dictionary, and the difference of the summed sizes over the text's bytes says which
dictionary knows the text better. A logistic curve turns the difference into the chance of the good label. A few bytes say
little, so the difference counts by a weight that grows with the text's length, and the curve goes to the share of good texts
among the shortest. It allows for a share of wrong labels, which would flatten it otherwise.

Fitting is bounded: at most `per_label` labelled documents of each label (those with the least hash of their identifier), at most
`segments` evenly spaced segments of each for the dictionaries. The curve must not see texts that the dictionaries have
learned, so the sample is halved by a hash, each half is measured with dictionaries of the other half, and the final
dictionaries come from both. The curve is shifted from the sample's share of good texts to that of all labels given. With too few segments for zstandard's training the segments themselves are the dictionary.

Null and empty texts have the weight 0, hence the curve's constant. With no labels of one kind every score is
the share of good labels (0.5 if there are none at all). Documents labelled more than once count once per label; null labels
do not count. Rows that repeat are scored alike; further columns pass through `score`, which replaces a clashing output column.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from callweave.llm.shared import first_by_hash, remainder, spread, table
from callweave.session import materialize

SEGMENT = 1000
LEVEL = 3
DICTIONARY = 60_000
PER_LABEL = 1500
SEGMENTS = 8
LENGTH = 200.0
THRESHOLD = 0.3
FOLDS, HELD_OUT_FOLD = 5, 0


@dataclass(frozen=True)
class Dictionaries:
    """Trained bytes for good and bad text."""

    good: bytes
    bad: bytes
    key: str


@dataclass(frozen=True)
class Model:
    dictionaries: Dictionaries
    weights: tuple[float, float, float]  # of the weighed difference, of the weight, constant
    noise: float


def segments_of(text: bytes) -> list[bytes]:
    return [text[i : i + SEGMENT] for i in range(0, len(text), SEGMENT)]


def train(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A zstandard dictionary, or the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


class Compressors:
    """One compressor per dictionary."""

    def __init__(self, dictionaries: Dictionaries):
        self.good, self.bad = (self._made(d) for d in (dictionaries.good, dictionaries.bad))

    @staticmethod
    def _made(content: bytes) -> zstandard.ZstdCompressor:
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if len(content) < 8:  # zstandard takes no shorter dictionary
            return zstandard.ZstdCompressor(**plain)
        dictionary = zstandard.ZstdCompressionDict(content)
        dictionary.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=dictionary, **plain)

    def difference(self, text: bytes | None) -> float:
        """Bytes that the bad dictionary needs beyond the good one, per byte of text."""
        if not text:
            return 0.0
        good, bad = self.good.compress, self.bad.compress
        return sum(len(bad(s)) - len(good(s)) for s in segments_of(text)) / len(text)


_made: dict[str, Compressors] = {}


def _compressors(dictionaries: Dictionaries) -> Compressors:
    if dictionaries.key not in _made:
        if len(_made) > 2:
            _made.clear()
        _made[dictionaries.key] = Compressors(dictionaries)
    return _made[dictionaries.key]


def differences(text: Column, dictionaries: Dictionaries) -> Column:
    @pandas_udf("double")
    def of_texts(texts: pd.Series) -> pd.Series:
        compressors = _compressors(dictionaries)
        return pd.Series([compressors.difference(t) for t in texts], dtype="float64")

    return of_texts(text.cast("string").cast("binary"))


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """Each (doc_id, label) that counts, once."""
    return labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("label IN (0, 1) AND doc_id IS NOT NULL").distinct()


def weight(text: Column) -> Column:
    """0 for no text towards 1 for a long one: how far its difference can be relied on."""
    size = F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("double")
    return size / (size + LENGTH)


def sample(docs: DataFrame, known: DataFrame, per_label: int) -> DataFrame:
    """(text, label, half) of the sampled documents; only identifiers are ranked."""
    chosen = first_by_hash(known, "label", "doc_id", per_label).select("doc_id", "label", (F.col("place") % 2).alias("half"))
    return materialize(docs.select("doc_id", "text").join(materialize(chosen), "doc_id"))


def _segments(sampled: DataFrame, count: int) -> pd.DataFrame:
    """Evenly spaced segments; at most `count` for each of the sampled documents."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, label, half in zip(batch["doc_id"], batch["text"], batch["label"], batch["half"], strict=True):
                found = segments_of((text or "").encode())
                for k in sorted({int(x) for x in np.linspace(0, len(found) - 1, min(count, len(found)))}):
                    rows.append((doc_id, label, half, k, found[k]))
            yield pd.DataFrame(rows, columns=["doc_id", "label", "half", "k", "segment"])

    schema = "doc_id long, label int, half int, k int, segment binary"
    frame = sampled.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "label", "half").mapInPandas(cut, schema).toPandas()
    frame["segment"] = frame["segment"].map(bytes)
    return frame.sort_values(["label", "doc_id", "k", "segment"])


def _trained(frame: pd.DataFrame) -> Dictionaries:
    good, bad = (train(frame.loc[frame["label"] == k, "segment"].tolist()) for k in (1, 0))
    return Dictionaries(good, bad, uuid.uuid4().hex)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression on the columns of `x` and a constant (last), with a slight ridge, by Newton steps."""
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    design = np.column_stack([x / scale, np.ones(len(x))])
    weights = np.zeros(design.shape[1])
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-np.clip(design @ weights, -35, 35)))
        slope = design.T @ (chance - y) + ridge * weights
        curve = (design * (chance * (1 - chance))[:, None]).T @ design + ridge * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights = weights - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return weights / np.append(scale, 1.0)


def noisy_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and the share of wrong labels; each round fits the curve to the labels believed so far."""
    noise = 0.01
    weights = logistic(x, y)
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -35, 35)))
        for_one, for_zero = chance * np.where(y == 1, 1 - noise, noise), (1 - chance) * np.where(y == 1, noise, 1 - noise)
        believed = for_one / (for_one + for_zero)
        noise = float(np.clip(np.abs(believed - y).mean(), 1e-4, 0.2))
        weights = logistic(x, believed)
    return weights, noise


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = PER_LABEL, segments: int = SEGMENTS) -> Model:
    """Dictionaries and curve from the labelled rows given; leave held-out rows out of `labels`."""
    known = labelled(labels, label)
    sampled = sample(docs, known, per_label)
    frame = _segments(sampled, segments)
    halves = [_trained(frame[frame["half"] != h]) for h in (0, 1)]
    measured = sampled.select(
        "label",
        F.when(F.col("half") == 0, differences(F.col("text"), halves[0]))
        .otherwise(differences(F.col("text"), halves[1]))
        .alias("difference"),
        weight(F.col("text")).alias("weight"),
    ).toPandas()  # three numbers for each sampled document
    good = int((measured["label"] == 1).sum())
    if good in (0, len(measured)):
        share = np.clip(good / len(measured) if len(measured) else 0.5, 1e-3, 1 - 1e-3)
        return Model(_trained(frame), (0.0, 0.0, float(np.log(share / (1 - share)))), 0.0)
    features = np.column_stack([measured["difference"] * measured["weight"], measured["weight"]])
    weights, noise = noisy_logistic(features, measured["label"].to_numpy(float))
    # the sample has other shares than the labels; the constant carries the difference
    share = known.agg(F.avg(F.col("label").cast("double"))).first()[0]
    shift = np.log(share / (1 - share)) - np.log(good / (len(measured) - good))
    return Model(_trained(frame), (float(weights[0]), float(weights[1]), float(weights[2] + shift)), noise)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the chance, 0 to 1, that a text is good."""
    by_difference, by_weight, constant = model.weights
    raised = weight(F.col(text)) * (F.lit(by_difference) * differences(F.col(text), model.dictionaries) + F.lit(by_weight)) + F.lit(constant)
    return docs.withColumn(out, F.lit(model.noise) + F.lit(1 - 2 * model.noise) / (1 + F.exp(-raised)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id, FOLDS) == HELD_OUT_FOLD, F.lit(False))


def op3_compression_quality(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels")
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    scored = score(spread(docs), model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
