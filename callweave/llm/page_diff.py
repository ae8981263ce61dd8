"""Main text of web pages: nearest-URL page differencing, and the marks of the markup.

A page is read into text lines (blocks of its markup). Lines inside an article or main element are content; lines inside
elements whose tag, role or class says menu, header, footer, sidebar, notice, advert, form or comments are not, wherever
they stand. What is left, on a page without a content element, the markup does not decide, and pages of one template are
compared instead: within each host the pages are sorted by URL path, each is paired with the neighbour whose
path agrees further, the lines of the two outside content elements are aligned by longest common subsequence, and the
shared ones are deleted. If that would delete nearly all of a page (COPY of its characters), the two are copies
of each other rather than of a template, and nothing is deleted.

Only 64-bit hashes of lines are compared between pages. Pages are sorted by ranges, so a host may be as
large as it likes, and neighbours meet in an equi join on their place in the order.

Null html is empty text. A null or unreadable URL has no host and is paired with none. Rows that repeat get
the same result each and are not paired with themselves. Further columns pass through `extract`; a clashing output
column replaces the input's. Unclosed elements end with their parents, a truncated page at its end.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from callweave.llm.shared import free_name, spread, table
from callweave.session import materialize

COPY = 0.9
NEUTRAL, CONTENT, MARKED = 0, 1, 2

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attributes2>[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")

# tag names by their part in a page
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rt rp s samp small span strike "
    "strong sub sup time tt u var wbr img".split()
)
SPACED = frozenset("br td th option hr".split())
MARKED_TAGS = frozenset(
    "head nav aside footer form menu dialog template noscript svg math object canvas audio video select button fieldset datalist".split()
)
MARKED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
CLOSES_ITSELF = frozenset("p li dt dd option tr td th".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
HEAD_TAGS = frozenset("base link meta noscript script style template title".split())
# words of class and id values
MARKED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion promotions banner "
    "cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay newsletter subscribe subscription signup "
    "share sharing social sidebar rail related recommended recommendations breadcrumb breadcrumbs menu menus nav navbar navigation "
    "topbar footer pagination pager widget widgets login comment comments commentlist respond disqus replies skip".split()
)
MARKED_OUTSIDE = frozenset("header masthead".split())
DISCUSSION = frozenset("comment comments commentlist respond disqus replies related recommended recommendations".split())
CONTENT_WORDS = frozenset("articlebody article-body article-content entry-content post-content post-body story-body main-content".split())


def _role(name: str, attributes: str, parent: int, firm: bool) -> tuple[int, bool]:
    """Role of an element inside `parent`, and whether it is firm, so that no content element inside lifts it."""
    values = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
    named = f"{values.get('class', '')} {values.get('id', '')}".lower().split() if values else []
    labels = {w for v in named for w in re.split(r"[^a-z0-9]+", v)}
    bare = attributes.lower().split()
    hidden = "hidden" in bare or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "").lower()
    if name in MARKED_TAGS or hidden or values.get("role", "").lower() in MARKED_ROLES or labels & DISCUSSION:
        return MARKED, True
    if parent == MARKED and firm:
        return MARKED, True
    if name not in ("html", "body") and labels & MARKED_WORDS:
        return MARKED, firm
    if parent != CONTENT and (name == "header" or labels & MARKED_OUTSIDE and name not in ("html", "body", "article", "main")):
        return MARKED, firm
    content = name in ("article", "main") or values.get("role", "").lower() in ("main", "article")
    if content or values.get("itemprop", "").lower() == "articlebody" or set(named) & CONTENT_WORDS:
        return CONTENT, False
    return parent, firm


def lines(page: str | None) -> list[tuple[str, int]]:
    """Text lines of a page in order, each with its role."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int, bool]] = []
    held: list[str] = []
    role, firm = NEUTRAL, False

    def end_line() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((text, role))
            held.clear()

    page = page or ""
    at, size = 0, len(page)
    while at < size:
        match = TOKEN.match(page, at)
        at = match.end()
        text = match["text"]
        if text is not None:
            held.append(html.unescape(text) if "&" in text else text)
            continue
        name = (match["name"] or match["name2"] or "").lower()
        if not name:
            continue
        if name in SPACED:
            held.append(" ")
        if name not in INLINE and name not in SPACED:
            end_line()
        if match["close"] or match["close2"]:
            depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == name), None)
            if depth is not None:
                end = stack[depth - 1][1:] if depth else (NEUTRAL, False)
                if end != (role, firm):
                    end_line()
                del stack[depth:]
                role, firm = end
            continue
        if name in VOID:
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = close.start() if close else size
            continue
        if name in ENDS_PARAGRAPH or name in CLOSES_ITSELF:
            own = name if name in CLOSES_ITSELF else "p"
            depth = len(stack) - 1
            while depth >= 0 and stack[depth][0] in INLINE:
                depth -= 1
            if depth >= 0 and stack[depth][0] in (own, "p"):
                del stack[depth:]
                role, firm = stack[-1][1:] if stack else (NEUTRAL, False)
        if stack and stack[-1][0] == "head" and name not in HEAD_TAGS:
            stack.pop()
            role, firm = stack[-1][1:] if stack else (NEUTRAL, False)
        new = _role(name, match["attributes"] or match["attributes2"] or "", role, firm)
        if new != (role, firm):
            end_line()
        stack.append((name, *new))
        role, firm = new
    end_line()
    return out


def main_text(page: str | None, shared: set[int] | frozenset[int] = frozenset()) -> str:
    """Content of a page; `shared` are the places, among its lines outside content elements, that a near page has too."""
    found = lines(page)
    if any(role == CONTENT for _, role in found):
        return "\n\n".join(text for text, role in found if role == CONTENT)
    return "\n\n".join(text for at, (text, role) in enumerate(found) if role == NEUTRAL and at not in shared)


def common_subsequence(a: list[int], b: list[int]) -> list[int]:
    """Places in `a` of a longest common subsequence with `b`.

    Divide and conquer over bit vectors: linear memory, one machine operation per row and 64 columns.
    """
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    middle = _divided(a[start : len(a) - end], b[start : len(b) - end])
    return [*range(start), *(start + i for i in middle), *range(len(a) - end, len(a))]


def _row(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the common subsequence of `a` with each prefix of `b`."""
    masks: dict[int, int] = {}
    for at, value in enumerate(b):
        masks[value] = masks.get(value, 0) | 1 << at
    full = (1 << len(b)) - 1
    vector = full
    for value in a:
        hit = vector & masks.get(value, 0)
        vector = (vector + hit | vector - hit) & full
    bits = np.unpackbits(np.frombuffer(vector.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _divided(a: list[int], b: list[int]) -> list[int]:
    known = set(b)
    if not a or not b:
        return []
    if len(a) == 1:
        return [0] if a[0] in known else []
    half = len(a) // 2
    cut = int((_row(a[:half], b) + _row(a[:half - 1 : -1], b[::-1])[::-1]).argmax())
    return [*_divided(a[:half], b[:cut]), *(half + i for i in _divided(a[half:], b[cut:]))]


def agreement(one: str, other: str) -> int:
    """Leading path parts that two paths share."""
    n = 0
    for a, b in zip(one.split("/"), other.split("/"), strict=False):
        if a != b:
            break
        n += 1
    return n


URL_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
URL_PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


def _key(pages: DataFrame, page_id: str, url: str, page: str) -> Column:
    """Stands for a row in joins: rows of equal identifier, URL and html are one."""
    return F.sha2(F.to_json(F.struct(F.col(page_id).alias("i"), F.col(url).alias("u"), F.sha2(F.col(page).cast("string"), 256).alias("h"))), 256)


def shared_lines(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, shared): the places of the lines outside content elements that the nearest page has too.

    Only for pages without a content element; with one, lines outside it are no content either way.
    """

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [lines(h) for h in batch["html"]]
            batch["open"] = [not any(role == CONTENT for _, role in f) and any(role == NEUTRAL for _, role in f) for f in found]
            outside = [[text for text, role in f if role != CONTENT] for f in found]
            batch["hashes"] = [[xxhash.xxh64_intdigest(t) - (1 << 63) for t in found] for found in outside]
            batch["sizes"] = [[len(t) for t in found] for found in outside]
            yield batch[["key", "host", "path", "open", "hashes", "sizes"]]

    host = F.nullif(F.lower(F.regexp_extract(url, URL_HOST, 1)), F.lit(""))
    narrow = pages.select(
        _key(pages, page_id, url, page).alias("key"), host.alias("host"), F.regexp_extract(url, URL_PATH, 1).alias("path"),
        F.col(page).cast("string").alias("html"),
    ).filter("host IS NOT NULL")
    schema = "key string, host string, path string, open boolean, hashes array<long>, sizes array<int>"
    order = ["host", "path", "key"]
    known = spread(narrow).mapInPandas(hashed, schema).filter("size(hashes) > 0")
    placed = materialize(known.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("at", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    numbered = materialize(
        placed.join(starts.drop("n"), "part").withColumn("place", F.col("start") + F.col("at") - F.shiftleft("part", 33)).drop("part", "start", "at")
    )
    sides = []
    for name, step in (("last", 1), ("next", -1)):
        side = numbered.select((F.col("place") + step).alias("place"), *[F.col(c).alias(f"{name}_{c}") for c in ("key", "host", "path", "hashes")])
        sides.append(side)
    met = numbered.filter("open")
    for name, side in zip(("last", "next"), sides, strict=True):
        met = met.join(side, "place", "left")
        near = F.col("host").eqNullSafe(F.col(f"{name}_host")) & (F.col("key") != F.col(f"{name}_key"))
        met = met.withColumns({f"{name}_{c}": F.when(near, F.col(f"{name}_{c}")) for c in ("path", "hashes")})

    @pandas_udf("array<int>")
    def aligned(
        path: pd.Series, own: pd.Series, sizes: pd.Series, last_path: pd.Series, last: pd.Series, next_path: pd.Series, after: pd.Series
    ) -> pd.Series:
        out = []
        for p, mine, lengths, lp, lv, np_, nv in zip(path, own, sizes, last_path, last, next_path, after, strict=True):
            options = [(agreement(p, q), v) for q, v in ((lp, lv), (np_, nv)) if v is not None]
            other = max(options, key=lambda o: o[0], default=(0, ()))[1]
            places = common_subsequence(list(mine), list(other))
            total, gone = sum(lengths), sum(lengths[i] for i in places)
            out.append([] if gone > COPY * total else places)
        return pd.Series(out)

    columns = ["path", "hashes", "sizes", "last_path", "last_hashes", "next_path", "next_hashes"]
    return met.select("key", aligned(*[F.col(c) for c in columns]).alias("shared")).filter("size(shared) > 0").dropDuplicates(["key"])


def extract(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", out: str = "text", size: str = "n_chars"
) -> DataFrame:
    """`pages` with the main text and its length in place of the html."""
    found = materialize(shared_lines(pages, page_id, url, page))

    @pandas_udf("string")
    def text_of(htmls: pd.Series, shared: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, frozenset(s if s is not None else ())) for h, s in zip(htmls, shared, strict=True)])

    kept = [c for c in pages.columns if c.lower() not in (page.lower(), out.lower(), size.lower())]
    key, whole, places = (free_name(pages.columns, n) for n in ("page_key", "whole_page", "shared_places"))
    keyed = pages.select(*kept, F.col(page).cast("string").alias(whole), _key(pages, page_id, url, page).alias(key))
    side = found.select(F.col("key").alias(key), F.col("shared").alias(places))
    joined = keyed.join(side, key, "left").select(*kept, text_of(F.col(whole), F.col(places)).alias(out))
    return joined.withColumn(size, F.length(out).cast("long"))


def op1_page_diff(spark, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages").select("page_id", "url", "html"))
