"""License scans: Dice coefficient over word bigrams against licence templates.

A text is compared in units: each line, each paragraph (lines up to a blank one) of several lines, and the whole text if it has
several paragraphs. A unit is normalised to lower-case words of letters and digits, and its set of word bigrams compared with
the sets of the templates. With the coefficient t wanted, 2|A and B| / (|A| + |B|) >= t bounds the size of one set by the other,
t / (2 - t) * |B| <= |A| <= (2 - t) / t * |B|, so only templates of fitting size are candidates.

A hit names the licence, not the template. Null, empty and one-word texts have no hits; equal coefficients go to the first licence by
name, then to the first unit. Rows that repeat are scanned each. Further columns pass through `hits` as an identifier would, if
named. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.licence_texts import TEMPLATES
from callweave.llm.shared import spread, table

THRESHOLD = 0.8
WORDS = regex.compile(r"[\p{L}\p{N}]+")


def bigrams(words: Sequence[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


class Matcher:
    """Templates as bigram sets, in the order of their size."""

    def __init__(self, templates: Sequence[tuple[str, str]], threshold: float):
        self.threshold = threshold
        sets = [(name, bigrams(words_of(text))) for name, text in templates]
        self.sets = sorted(((len(s), name, s) for name, s in sets if s), key=lambda t: t[:2])
        least, most = (self.sets[0][0], self.sets[-1][0]) if self.sets else (1, 0)
        self.shortest = least * threshold / (2 - threshold)
        self.longest = most * (2 - threshold) / threshold

    def best(self, words: Sequence[str]) -> dict[str, float]:
        """Coefficient of each licence that reaches the threshold."""
        if len(words) - 1 < self.shortest:
            return {}
        own = bigrams(words)
        n = len(own)
        if n > self.longest:
            return {}
        found: dict[str, float] = {}
        for size, name, template in self.sets:
            if size > n * (2 - self.threshold) / self.threshold:
                break
            if size < n * self.threshold / (2 - self.threshold):
                continue
            dice = 2 * len(own & template) / (n + size)
            if dice >= self.threshold:
                found[name] = max(dice, found.get(name, 0.0))
        return found

    def hits(self, text: str | None) -> list[tuple[str, str, int, int, float]]:
        """(licence, unit, first line, last line, coefficient), lines counted from 1."""
        found = []
        lines = [words_of(line) for line in (text or "").split("\n")]
        paragraphs: list[tuple[int, int]] = []
        for at, words in enumerate(lines):
            if words and paragraphs and paragraphs[-1][1] == at - 1:
                paragraphs[-1] = (paragraphs[-1][0], at)
            elif words:
                paragraphs.append((at, at))
            found += [(name, "line", at + 1, at + 1, dice) for name, dice in self.best(words).items()]
        spans = [("paragraph", a, b) for a, b in paragraphs if b > a]
        if len(paragraphs) > 1:
            spans.append(("text", paragraphs[0][0], paragraphs[-1][1]))
        for unit, a, b in spans:
            joined = [w for words in lines[a : b + 1] for w in words]
            found += [(name, unit, a + 1, b + 1, dice) for name, dice in self.best(joined).items()]
        return found


def hits(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: Sequence[tuple[str, str]] = tuple(TEMPLATES), threshold: float = THRESHOLD
) -> DataFrame:
    """One row per document and the hits of its text as an array."""

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(templates, threshold)
        names = ("licence", "unit", "first_line", "last_line", "dice")
        for batch in batches:
            batch["hits"] = [[dict(zip(names, h, strict=True)) for h in matcher.hits(t)] for t in batch.pop("text")]
            yield batch

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, hits array<struct<licence: string, unit: string, first_line: int, last_line: int, dice: double>>"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInPandas(scanned, schema)


def op10_licence_scan(spark, folder: str) -> DataFrame:
    """Per document: its licences, and the best with its coefficient and number of units that hit."""
    found = hits(spread(table(spark, folder, "documents").select("doc_id", "text")))
    ranked = F.array_sort(F.transform("hits", lambda h: F.struct((-h["dice"]).alias("less"), h["licence"].alias("licence"))))
    best = F.get(ranked, F.lit(0))
    return found.select(
        "doc_id", F.array_join(F.array_sort(F.array_distinct(F.col("hits.licence"))), ",").alias("licences"),
        best["licence"].alias("best_licence"), (-best["less"]).alias("best_dice"), F.size("hits").cast("long").alias("n_hits"),
    )


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
ORACLE = f"""
    WITH templates AS (
        SELECT licence, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS b
        FROM (SELECT licence, {_WORDS.format('notice')} AS w
              FROM (VALUES {', '.join(f'({_sql_text(n)}, {_sql_text(t)})' for n, t in TEMPLATES)}) AS v(licence, notice))),
    lines AS (
        SELECT r, doc_id, i, {_WORDS.format('line')} AS w
        FROM (SELECT r, doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line
              FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
    full_lines AS (SELECT *, i - row_number() OVER (PARTITION BY r ORDER BY i) AS para FROM lines WHERE len(w) > 0),
    units AS (
        SELECT r, w FROM full_lines
        UNION ALL SELECT r, flatten(list(w ORDER BY i)) FROM full_lines GROUP BY r, para HAVING count(*) > 1
        UNION ALL SELECT r, flatten(list(w ORDER BY i)) FROM full_lines GROUP BY r HAVING count(DISTINCT para) > 1),
    grams AS (SELECT r, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS b FROM units WHERE len(w) > 1),
    found AS (
        SELECT r, u, licence, max(dice) AS dice
        FROM (SELECT g.r, g.u, t.licence, 2 * len(list_intersect(g.b, t.b)) / (len(g.b) + len(t.b)) AS dice
              FROM (SELECT *, row_number() OVER () AS u FROM grams) g
              JOIN templates t ON len(g.b) BETWEEN {THRESHOLD} / {2 - THRESHOLD} * len(t.b) - 1e-9 AND {2 - THRESHOLD} / {THRESHOLD} * len(t.b) + 1e-9)
        WHERE dice >= {THRESHOLD} GROUP BY r, u, licence),
    docs AS (SELECT row_number() OVER () AS r, doc_id FROM documents)
    SELECT doc_id, coalesce(string_agg(DISTINCT licence, ',' ORDER BY licence), '') AS licences,
           first(licence ORDER BY dice DESC, licence) AS best_licence, max(dice) AS best_dice, count(licence) AS n_hits
    FROM docs LEFT JOIN found USING (r) GROUP BY r, doc_id
"""
