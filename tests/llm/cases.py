"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = f"{DOCS}, row long, print string, key string, ids string, kept string, score string, lang_pred string, component_id string"

_RND = random.Random(5)
_WORDS = [f"{a}{b}" for a in ("ra", "to", "mi", "sel", "kor") for b in ("na", "pe", "lu", "dis", "vo", "th")]


def prose(n: int, seed: int = 0) -> str:
    return " ".join(random.Random(seed).choices(_WORDS, k=n))


def documents() -> list[tuple]:
    long_text = prose(20_000, 1)
    rows = [
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \t\n", "en", None, 3),
        (4, "one two three", "en", "b", 13),
        (5, "one  two\nthree ", None, "b", 15),
        (6, "onetwothree", "en", None, 11),
        (7, long_text, "en", "c", len(long_text)),
        (8, long_text + " end", "en", "c", len(long_text) + 4),
        (9, "naïve café 漢字 🙂", "fr", "", 15),
        (9, "naïve café 漢字 🙂", "fr", "", 15),
        (None, "one two three", "en", "b", 13),
        (None, None, None, None, None),
    ]
    base = prose(400, 2).split()
    for k in range(40):  # near copies: one word changed each
        words = list(base)
        words[(k * 9) % 400] = "changed"
        rows.append((100 + k, " ".join(words), "en", "a", 1))
    rows += [(200 + k, prose(30 + k, 100 + k), "en" if k % 2 else "fr", "abc"[k % 3], 1) for k in range(60)]
    return rows


def with_extra(spark, rows=None):
    """The documents under a schema whose further columns have the names that the operators use inside."""
    rows = documents() if rows is None else rows
    return spark.createDataFrame([(*r, 7, "p", "k", "i", "kept", "s", "l", "c") for r in rows], EXTRA)


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, DOCS)
