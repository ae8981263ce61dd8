"""Language identification by unigram pieces, summed over all segmentations of a word.

A fixed public byte vocabulary supplies the pieces. Every language has a probability per piece; the probability
of a word is the sum over all ways to cut it into pieces, which a forward pass over the bytes of the word gives. A text's
log-likelihood is the sum over its words: runs of letters, in lower case, with a blank in front.

Fitting: a bounded sample of labelled documents per language (`docs_per_language`, those with the least hash of
their identifier) is counted into words by Spark, and expectation-maximisation runs as Spark jobs over the words: each round
every task gathers expected piece counts by forward and backward passes, and their sums (vocabulary x languages)
make the next probabilities. Words of any length train.

Prediction: the language of the greatest likelihood. The score is its posterior with log-likelihoods divided by the root of
the number of words, since the words of a text are far from independent. Texts that are null or have no letter give `und` with
score 0, and so does every text if nothing was learned (empty table, no labels). Equally likely languages go to the first by name.
Rows that repeat are predicted alike, further columns are not looked at.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from callweave.llm.shared import alone, first_by_hash, kept_by, remainder, small_batches, spread, table
from callweave.session import materialize

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
DOCS_PER_LANGUAGE = 300
ROUNDS = 4
SMOOTHING = 0.1
REMEMBERED = 300_000
CHARACTERS_AT_ONCE = 1_000_000
RESCALE_EVERY = 16
WORDS_AT_ONCE = 20_000
UNKNOWN = "und"
FOLDS, HELD_OUT_FOLD = 4, 2

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


@lru_cache(2)
def pieces(path: str) -> dict[bytes, int]:
    """Number of every vocabulary piece that a word can hold: single bytes, and letters with or without a blank."""
    with open(path, "rb") as lines:
        tokens = [base64.b64decode(line.split()[0]) for line in lines]
    fitting = re.compile(rb" ?[^\x00-\x60\x7b-\x7f]*")  # bytes of lower-case or non-ASCII letters
    kept = sorted({bytes([b]) for b in range(256)} | {t for t in tokens if fitting.fullmatch(t)})
    return {t: i for i, t in enumerate(kept)}


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    probability: np.ndarray  # pieces x languages
    path: str
    key: str


def _lookups(group: list[bytes], i: int, j: int, index: dict[bytes, int]) -> np.ndarray | None:
    """Piece number of bytes i to j of each word, the last row of the table where there is no such piece."""
    none = len(index)
    found = np.array([index.get(w[i:j], none) for w in group])
    return None if (found == none).all() else found


def _by_length(coded: list[bytes]) -> Iterator[np.ndarray]:
    places: dict[int, list[int]] = defaultdict(list)
    for at, word in enumerate(coded):
        places[len(word)].append(at)
    for chosen in places.values():
        for a in range(0, len(chosen), WORDS_AT_ONCE):
            yield np.array(chosen[a : a + WORDS_AT_ONCE])


def log_marginals(coded: list[bytes], index: dict[bytes, int], probability: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all segmentations, words x languages."""
    widest = max(map(len, index))
    padded = np.vstack([probability, np.zeros((1, probability.shape[1]))])
    out = np.zeros((len(coded), probability.shape[1]))
    for chosen in _by_length(coded):
        group = [coded[i] for i in chosen]
        forward: dict[int, np.ndarray] = {0: np.ones((len(group), probability.shape[1]))}
        logs = np.zeros_like(forward[0])
        for j in range(1, len(group[0]) + 1):
            total = np.zeros_like(logs)
            for i in range(max(0, j - widest), j):
                found = _lookups(group, i, j, index)
                if found is not None:
                    total += forward[i] * padded[found]
            forward[j] = total
            forward.pop(j - widest, None)
            if j % RESCALE_EVERY == 0:
                scale = np.maximum.reduce(list(forward.values()))
                forward = {k: v / scale for k, v in forward.items()}
                logs += np.log(scale)
        out[chosen] = logs + np.log(forward[len(group[0])])
    return out


def expected_counts(coded: list[bytes], language: np.ndarray, count: np.ndarray, index: dict[bytes, int], probability: np.ndarray) -> np.ndarray:
    """Expected number of each piece in each language, pieces x languages, over all segmentations."""
    with np.errstate(divide="ignore"):
        logs = np.log(np.vstack([probability, np.zeros((1, probability.shape[1]))]))
    sums = np.zeros_like(logs)
    widest = max(map(len, index))
    for chosen in _by_length(coded):
        group, k, n = [coded[i] for i in chosen], language[chosen], count[chosen]
        size = len(group[0])
        # logarithms, which no word is too long for
        arcs: dict[tuple[int, int], np.ndarray] = {}
        ahead = np.full((size + 1, len(group)), -np.inf)
        ahead[0] = 0
        for j in range(1, size + 1):
            for i in range(max(0, j - widest), j):
                found = _lookups(group, i, j, index)
                if found is not None:
                    arcs[i, j] = found
                    ahead[j] = np.logaddexp(ahead[j], ahead[i] + logs[found, k])
        behind = np.full_like(ahead, -np.inf)
        behind[size] = 0
        for (i, j), found in sorted(arcs.items(), key=lambda a: -a[0][1]):
            behind[i] = np.logaddexp(behind[i], logs[found, k] + behind[j])
        for (i, j), found in arcs.items():
            np.add.at(sums, (found, k), np.exp(ahead[i] + logs[found, k] + behind[j] - ahead[size]) * n)
    return sums[:-1]


def _coded(listed: list[str]) -> list[bytes]:
    return [b" " + w.encode() for w in listed]


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """(text, lang) of up to `per_language` documents a language; identifiers are ranked without their texts."""
    labelled = docs.filter("lang IS NOT NULL").select("doc_id", "lang")
    chosen = first_by_hash(labelled, "lang", "doc_id", per_language).select("doc_id", "lang").distinct()
    return docs.select("doc_id", "lang", "text").join(materialize(chosen), ["doc_id", "lang"])


def fit(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, rounds: int = ROUNDS, vocabulary: str = VOCABULARY) -> Model:
    """Piece probabilities of each `lang`, learned from `text`."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter = Counter()
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                found.update((lang, w) for w in words(text))
            yield pd.DataFrame([(lang, w, n) for (lang, w), n in found.items()], columns=["lang", "word", "n"])

    path = public_tokenizers.path(vocabulary)
    counts = sample(docs, per_language).select("text", "lang").mapInPandas(counted, "lang string, word string, n long")
    counts = materialize(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    languages = tuple(r[0] for r in counts.select("lang").distinct().orderBy("lang").collect())
    index = pieces(path)
    probability = np.full((len(index), len(languages)), 1 / len(index))
    for _ in range(rounds if languages else 0):
        probability = _round(counts, languages, path, probability)
    return Model(languages, probability, path, uuid.uuid4().hex)


def _round(counts: DataFrame, languages: tuple[str, ...], path: str, probability: np.ndarray) -> np.ndarray:
    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = {lang: k for k, lang in enumerate(languages)}
        for batch in batches:
            sums = expected_counts(
                _coded(batch["word"].tolist()), batch["lang"].map(place).to_numpy(), batch["n"].to_numpy(float), pieces(path), probability
            )
            piece, language = np.nonzero(sums)
            yield pd.DataFrame({"piece": piece, "language": language, "n": sums[piece, language]})

    found = spread(counts).mapInPandas(gathered, "piece int, language int, n double")
    total = found.groupBy("piece", "language").agg(F.sum("n").alias("n")).toPandas()  # at most pieces x languages
    sums = np.full(probability.shape, SMOOTHING)
    sums[total["piece"], total["language"]] += total["n"]
    return sums / sums.sum(axis=0)


class Scorer:
    """Log-likelihoods of texts.

    Remembers about REMEMBERED words in two generations, so that common words outlive rare ones. That changes time only.
    """

    def __init__(self, model: Model):
        self.model = model
        self.index = pieces(model.path)
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.languages)))
        self.old, self.old_rows = self.known, self.rows

    def _learn(self, listed: set[str]) -> None:
        new = [w for w in listed if w not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > REMEMBERED // 2 and self.known:
            self.old, self.old_rows, self.known, self.rows = self.known, self.rows, {}, self.rows[:0]
            new = list(listed)
        seen = [w for w in new if w in self.old]
        fresh = [w for w in new if w not in self.old]
        found = [self.old_rows[[self.old[w] for w in seen]], log_marginals(_coded(fresh), self.index, self.model.probability)]
        self.known.update(zip([*seen, *fresh], range(len(self.rows), len(self.rows) + len(new)), strict=True))
        self.rows = np.vstack([self.rows, *found])

    def likelihood(self, listed: list[str]) -> np.ndarray:
        self._learn(set(listed))
        return self.rows[[self.known[w] for w in listed]].sum(axis=0)

    def prefetch(self, texts: list[list[str]]) -> None:
        """Learn the words of several texts at once; words of one length share a pass."""
        self._learn({w for listed in texts for w in listed})

    def predict(self, listed: list[str]) -> tuple[str, float]:
        if not listed or not self.model.languages:
            return UNKNOWN, 0.0
        scaled = self.likelihood(listed) / np.sqrt(len(listed))
        best = int(scaled.argmax())
        return self.model.languages[best], float(1 / np.exp(scaled - scaled[best]).sum())


_scorers: dict[str, Scorer] = {}
kept_by("langid", _scorers.clear)


def _scorer(model: Model) -> Scorer:
    if model.key not in _scorers:
        _scorers.clear()
        _scorers[model.key] = Scorer(model)
    return _scorers[model.key]


def predicted(text: Column, model: Model) -> Column:
    """Struct (lang, score) of a text column."""

    @pandas_udf("lang string, score double")
    def of_texts(texts: pd.Series) -> pd.DataFrame:
        alone("langid")
        scorer, out = _scorer(model), []
        part = (texts.str.len().fillna(0).cumsum() // CHARACTERS_AT_ONCE).to_numpy()
        edges = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), len(texts)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            listed = [words(t) for t in texts.iloc[a:b]]
            scorer.prefetch(listed)
            out += [scorer.predict(w) for w in listed]
        return pd.DataFrame(out, columns=["lang", "score"])

    return of_texts(text.cast("string"))


def predict(docs: DataFrame, model: Model, out: str = "lang_pred", score: str = "score", text: str = "text") -> DataFrame:
    """`docs` with the predicted language and its score."""
    small_batches(docs.sparkSession)
    return docs.withColumn(out, predicted(F.col(text), model)).withColumns({score: F.col(out)["score"], out: F.col(out)["lang"]})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id, FOLDS) == HELD_OUT_FOLD, F.lit(False))


def op4_language_id(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    marked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(spread(marked), model).select("doc_id", "held_out", "lang_pred", "score")
