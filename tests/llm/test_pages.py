from __future__ import annotations

import random

import pytest

from callweave.llm import page_diff

SCHEMA = "page_id long, url string, html string, key string, page_key string, shared string, host string, text string"

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>x</p>";</script></head><body class="has-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- note <p>no</p> -->
<div class="ad-box"><p>Buy &amp; save</p></div><div id="cookie-notice">We use cookies</div>
<article><header><h1>Head&shy;line &eacute;&#233;</h1></header><p>First <b>bold
 text<br>next</p><p>Second &lt;b&gt; <a href="a>b">link</a><form><p>Sign up</p></form>
<ul><li>one<li>two</ul><div class="share">Share</div><aside>Aside</aside><table><tr><td>a</td><td>b</td></tr></table></article>
<section class="comments"><article><p>Nice post</p></article></section><footer>&copy; me</footer></body></html>"""
WANT = "Head­line éé\n\nFirst bold text next\n\nSecond <b> link\n\none\n\ntwo\n\na b"


def test_marks_of_the_markup():
    assert page_diff.main_text(ARTICLE) == WANT


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""), ("", ""), ("plain &amp text", "plain & text"), ("<p>cut <b>off", "cut off"), ("<article><p>cut <a href='x", "cut"),
        ("a < b > c", "a < b > c"), ("<p>x</p></p></div><p>y</p>", "x\n\ny"), ("<script>if (a</b>c) x()</script>tail", "tail"),
        ("<script>never closed", ""), ("<!-- never closed <p>x", ""), ("<div hidden>no</div>yes", "yes"),
        ("<div class='page with-sidebar'><main><p>kept</p></main></div>", "kept"), ("<nav><article>no</article></nav>yes", "yes"),
        ("<p>1<p>2<div>3</div>", "1\n\n2\n\n3"), ("<head><meta charset=u><p>body text", "body text"), ('<p title="1 > 0">z</p>', "z"),
    ],
)
def test_odd_markup(html, want):
    assert page_diff.main_text(html) == want


def test_alignment_is_a_longest_one():
    rnd = random.Random(2)
    for _ in range(1500):
        a = [rnd.randint(0, 4) for _ in range(rnd.randint(0, 14))]
        b = [rnd.randint(0, 4) for _ in range(rnd.randint(0, 14))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        places = page_diff.common_subsequence(a, b)
        rest = iter(b)
        assert places == sorted(set(places)) and len(places) == table[-1][-1] and all(a[p] in rest for p in places)


def template(n):
    return f"<body><div>Welcome to our site</div><div>All rights reserved here</div><p>Story {n} is told in these words only.</p><p>More of {n}.</p><div>Call us today</div>"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "p", "s", "h", "t") for r in rows], SCHEMA)


def test_shared_lines_go_where_nothing_is_marked(spark):
    rows = [(i, f"https://a.example/{'x' if i < 5 else 'y'}/{i}?q={i}", template(i)) for i in range(9)]
    rows += [(20, "https://b.example/x/1", template(20)), (21, None, template(21)), (22, "no url", template(22)), (23, "https://a.example/x/9", None)]
    rows += [(24, "https://c.example/1", template(24)), (25, "https://c.example/1/print", template(24)), (25, "https://c.example/1/print", template(24))]
    got = {r.page_id: r for r in page_diff.extract(frame(spark, rows)).collect()}
    for i in range(9):
        assert got[i].text == f"Story {i} is told in these words only.\n\nMore of {i}."
        assert got[i].n_chars == len(got[i].text)
        assert (got[i].key, got[i].page_key, got[i].shared, got[i].host) == ("k", "p", "s", "h")
    whole = "Welcome to our site\n\nAll rights reserved here\n\nStory {0} is told in these words only.\n\nMore of {0}.\n\nCall us today"
    for i in (20, 21, 22, 24):
        assert got[i].text == whole.format(i)
    assert got[25].text == whole.format(24)
    assert (got[23].text, got[23].n_chars) == ("", 0)


def test_every_row_stays_and_the_empty_table(spark):
    rows = [(1, "https://a.example/1", ARTICLE), (1, "https://a.example/1", ARTICLE), (None, None, None)]
    got = page_diff.extract(frame(spark, rows)).collect()
    assert sorted(r.text for r in got) == ["", WANT, WANT]
    assert page_diff.extract(frame(spark, [])).collect() == []


def test_a_common_host_is_paired_across_ranges(spark):
    rows = [(i, f"https://a.example/{i:04d}", template(i)) for i in range(120)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = page_diff.extract(frame(spark, rows).repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert all(r.text.startswith("Story") for r in got) and len(got) == 120
