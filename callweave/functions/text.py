"""Sentence splitting and cleaning with built-in functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

from callweave.functions.fixed import CALL_STOPWORDS

SENTENCE_MARK = "\u0001"
SENTENCE_END = r"([.!?])\s+"

# whole-token stand-ins for the entity types that rules can tell: money, percent, ordinals,
# times, dates and plain numbers. Person names need a tagger and stay.
NUMERIC_TOKEN = r"^[$€£]?[-+]?\d[\d.,:/-]*(%|st|nd|rd|th|am|pm|bn|k|m)?$"
EDGE_PUNCTUATION = r"^[^\p{L}\p{N}$€£+-]+|[^\p{L}\p{N}%]+$"


def default_stopwords() -> list[str]:
    """Spark's English stop words and the call-talk words (needs a running session)."""
    return sorted(set(StopWordsRemover.loadDefaultStopWords("english")) | set(CALL_STOPWORDS))


def split_sentences(text: Column) -> Column:
    """Trimmed, non-blank sentences of `text` in order."""
    marked = F.regexp_replace(text, SENTENCE_END, "$1" + SENTENCE_MARK)
    pieces = F.transform(F.split(marked, SENTENCE_MARK), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(pieces, lambda s: s != "")


def _lettered(word: Column) -> Column:
    """Whether the first character is a letter a to z, by a comparison of bytes."""
    return (word >= "a") & (word < "{")


def tokens(text: Column) -> Column:
    """Lower-case tokens without edge punctuation; the pattern is left to words that do not begin and end with a letter a to z."""

    def stripped(word: Column) -> Column:
        return F.when(_lettered(word) & _lettered(F.substring(word, -1, 1)), word).otherwise(F.regexp_replace(word, EDGE_PUNCTUATION, ""))

    return F.filter(F.transform(F.split(F.lower(text), r"\s+"), stripped), lambda w: w != "")


def content_tokens(text: Column, stopwords: Sequence[str]) -> Column:
    """Tokens that are neither stop words nor number-like."""

    def keep(word: Column) -> Column:
        # the cheap tests come first: what begins with a letter is no number, and a set lookup is cheaper than the pattern
        plain = _lettered(word) | ~word.rlike(NUMERIC_TOKEN)
        return ~word.isin(*stopwords) & plain if stopwords else plain

    return F.filter(tokens(text), keep)


def clean(text: Column, stopwords: Sequence[str]) -> Column:
    return F.array_join(content_tokens(text, stopwords), " ")


def ngrams(words: Column, low: int = 1, high: int = 2) -> Column:
    """All n-grams of sizes low..high, joined with a blank; one pass over the list per size."""

    def of_size(n: int) -> Column:
        count = F.greatest(F.size(words) - (n - 1), F.lit(0))
        grams = F.slice(words, F.lit(1), count)
        for shift in range(2, n + 1):
            grams = F.zip_with(grams, F.slice(words, F.lit(shift), count), lambda a, b: F.concat_ws(" ", a, b))
        return grams

    return F.concat(*[of_size(n) for n in range(low, high + 1)])


def sentence_id(firm: Column, transcript: Column, position: Column) -> Column:
    return F.format_string("%s_%s_%04d", firm, transcript, position)


def whole_id(value: Column) -> Column:
    """Transcript ids that were read as floats, written as integers again."""
    number = value.try_cast("double")
    return F.when(
        value.cast("string").rlike(r"^\d+\.0+$"), number.cast("bigint").cast("string")
    ).otherwise(value.cast("string"))


def safe_name(name: Column, limit: int | None = None, keep: str = "") -> Column:
    """Name with every other character than letters, digits and `keep` as an underscore."""
    cut = F.substring(name, 1, limit) if limit else name
    return F.regexp_replace(cut, rf"[^\p{{L}}\p{{N}}{keep}]", "_")


def shorten(name: Column, width: int = 50) -> Column:
    return F.when(F.length(name) > width, F.concat(F.substring(name, 1, width - 3), F.lit("..."))).otherwise(name)


def quarter_key(quarter: Column) -> Column:
    return F.upper(F.regexp_replace(quarter, "[- ]", ""))


def bullets(sentences: Column, limit: int) -> Column:
    return F.array_join(F.transform(F.slice(sentences, 1, limit), lambda s: F.concat(F.lit("- "), s)), "\n")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def missing_text(text: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(text, F.lit(""))
