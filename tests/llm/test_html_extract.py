import math
import time
from xml.etree import ElementTree

import pytest
from hypothesis import given, settings, strategies as st

from evigraph.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1><p>Slogan of the site</p></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></ul></nav>
<div id="cookie-notice">We use cookies. <button>OK</button></div><div class="sidebar"><p>Popular <a href=x>one</a> <a href=y>two</a></p></div>
<article class="post"><h1>Title &amp; more</h1><p>First   paragraph, <b>bold<br>text</b> here.<p>Second &lt;para&gt;
with a <a href="z">link</a>.</p><form><input name=q><label>Search</label></form><div class="ad">Buy now</div>
<ul><li>point one<li>point two</ul><!-- gone --></article>
<section class="comments"><p>Great article, thanks a lot for all of this text which is long enough to win.</p></section>
<footer>&copy; 2020</footer></body></html>"""


def test_page():
    assert H.extract(PAGE) == "Title & more\n\nFirst paragraph, bold text here.\n\nSecond <para> with a link.\n\npoint one\n\npoint two"


def test_without_article_element():
    page = "<body><div><a href=1>a</a> <a href=2>b</a> <a href=3>c</a></div><div><h2>Head</h2><p>%s</p><p>%s</p></div></body>" % ("long text " * 30, "more text " * 20)
    got = H.extract(page)
    assert got == "Head\n\n" + ("long text " * 30).strip() + "\n\n" + ("more text " * 20).strip()


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), (" \n ", ""), ("plain words", "plain words"), ("<p>a<div>b</div>c", "a\n\nb\n\nc"), ("a < b &amp; c <b>x", "a < b & c x"), ("<script>x", ""),
        ("<p>x</p>tail<p>y</p>", "x\n\ntail\n\ny"), ("<div>" * 20_000 + "deep", "deep"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"), ("</p></div>x", "x"),
        ("<ul><li>a<li>b <ul><li>c</ul> d</ul>", "a\n\nb\n\nc\n\nd"), ('<div class="content has-sidebar comments-open"><p>x</p></div><div class=sidebar>s</div>', "x"),
        ('<div id="site-header">Site</div><article><header><h1>T</h1></header><p>x</p><article class="comment">c</article></article>', "T\n\nx"), ('<p title="x>one</p><p>two</p>', "one\n\ntwo"), ("<p>a&nbsp;&#x41;&eacute;</p>", "a Aé"), ("<p>İİ<script>1</script>z</p>", "İİz"),
    ],
)
def test_odd_pages(page, text):
    assert H.extract(page) == text


def test_long_page_whole():
    body = "".join(f"<p>para {i} words</p>" for i in range(20_000))
    assert H.extract(f"<body><article>{body}</article></body>") == "\n\n".join(f"para {i} words" for i in range(20_000))


@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<a href=x>", "</a>", "<li>", "<ul>", "</ul>", "<br>", "<nav>", "</nav>", "<!--", "-->", "text", " ", "<", "&amp;", "<td>", "<table>", "</table>"]), max_size=40))
@settings(max_examples=150, deadline=None)
def test_never_fails(parts):
    assert isinstance(H.extract("".join(parts)), str)


def test_table(spark):
    df = spark.createDataFrame([(1, "http://a", PAGE, "x"), (1, "http://a", PAGE, "x"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, H.main_text(df).collect()), key=str)
    assert len(got) == 3 and got[0] == got[1] and got[2] == (2, None, "", 0) and got[0][3] == len(got[0][2])
    assert H.main_text(df.limit(0)).count() == 0


PARAGRAPHS = "".join(f"<p>{f'long text {i} ' * 25}</p>" for i in range(10))
SPARSE = "<ul>" + "".join(f"<li>item {i:02} {'of a list of short lines ' * 2}</li>" for i in range(12)) + "</ul>"


@pytest.mark.parametrize(
    "page",
    [
        "<body><article><h1>Headline</h1><div>%s</div></article></body>" % PARAGRAPHS,
        "<body><article><h1>Headline</h1><div>%s</div><section><h2>More</h2>%s</section></article></body>" % (PARAGRAPHS, SPARSE),
        "<body><main><h1>Headline</h1><article><section>%s</section></article><section>%s</section></main></body>" % (PARAGRAPHS, SPARSE),
        "<body><ul><li><a href=1>Home</a><li><a href=2>News</a></ul><h1>Headline</h1><div><div>%s</div></div><section>%s</section></body>" % (PARAGRAPHS, SPARSE),
    ],
)
def test_wrapped_and_several_sections(page):
    got = H.extract(page)
    assert got.startswith("Headline\n\n") and all(f"long text {i} " in got for i in range(10)) and "Home" not in got
    assert all(f"item {i:02} of" in got for i in range(12)) or SPARSE not in page


# pages that name nothing: no article element, no telling class
def _long(k, n):
    return "".join(f"<p>{f'sentence {k} {i} of a long paragraph ' * 8}</p>" for i in range(n))


LINKS = "<div>" + "".join(f"<div><a href='/{i}'>Go to {i}</a></div>" for i in range(9)) + "</div>"
PLAIN_PAGES = [
    (f"<body><div>{LINKS}</div><h1>Head</h1><div>{_long(1, 6)}</div><div>Short line below</div></body>", ["Head", "sentence 1 5"], ["Go to 3", "Short line below"]),
    (f"<body><div><span>Site</span> <a href='/'>Home</a></div><div><div><h1>Head</h1></div><div>{_long(2, 5)}</div><div><div>1</div><div>2</div><div>3</div></div></div>{LINKS}</body>", ["Head", "sentence 2 4"], ["Go to 3", "Home", "1\n\n2"]),
    (f"<body><div>Welcome back</div><div><h2>Part</h2>{_long(3, 4)}</div><div><h2>Other part</h2>{_long(4, 4)}</div><div>Terms</div>{LINKS}</body>", ["Part", "sentence 3 3", "Other part", "sentence 4 3"], ["Go to 3", "Welcome back", "Terms"]),
    (f"<body><article><p>Teaser one</p></article><article><h1>Head</h1>{_long(5, 4)}<p>Short end.</p></article><article><p>Teaser two</p></article>{LINKS}</body>", ["Head", "sentence 5 3", "Short end."], ["Go to 3", "Teaser"]),
]


@pytest.mark.parametrize("page,inside,outside", PLAIN_PAGES)
def test_density_decides(page, inside, outside, monkeypatch):
    got = H.extract(page)
    assert all(x in got for x in inside) and not any(x in got for x in outside), got
    monkeypatch.setattr(H, "_core", lambda dom, texts: [True] * len(dom.name))
    assert any(x in H.extract(page) for x in outside)


def own_densities(page):
    """Densities of a well-formed page's elements in document order, by recursion over another parser's tree."""
    root = ElementTree.fromstring(page)
    out = []

    def measure(e, linked):
        linked = linked or e.tag == "a"
        c = len((e.text or "").strip())
        lc, t, lt = c * linked, 0, 0
        place = len(out)
        out.append(None)
        for child in e:
            sub = measure(child, linked)
            tail = len((child.tail or "").strip())
            c, lc, t, lt = c + sub[0] + tail, lc + sub[1] + tail * linked, t + 1 + sub[2], lt + (child.tag == "a") + sub[3]
        out[place] = (e.tag, c, lc, t, lt)
        return c, lc, t, lt

    total, link, _, _ = measure(root, False)
    share = link / total

    def one(c, lc, t, lt):
        if not c:
            return 0.0
        t = max(t, 1)
        gain = math.log(max(c / max(lc, 1) * t / max(lt, 1), 1) + 1)
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        return c / t * gain / (1 + math.log(base))

    return [(tag, one(*rest)) for tag, *rest in out]


@pytest.mark.parametrize("page", [p.replace("'", '"') for p, _, _ in PLAIN_PAGES])
def test_densities_against_another_tree(page):
    dom = H.parse(page)
    density = H.densities(dom, dom.runs)[0]
    want = own_densities(page)
    assert dom.name[1:] == [tag for tag, _ in want]
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, (_, b) in zip(density[1:], want))


BROKEN = {
    "quotes": lambda n: '<a "' * n, "two quotes": lambda n: "<a \"' " * n + ">", "open": lambda n: "<b>" * n, "items": lambda n: "<b>" * n + "<li>" * n, "names": lambda n: '<b<b"' * n, "cells": lambda n: "<table><tr>" + "<td>" * n,
    "ends": lambda n: "<div>" * n + "</p>" * n, "lists": lambda n: "<ul><li>x" * n, "brackets": lambda n: "<" * n, "attributes": lambda n: "<a " + "class=" * n + ">", "mixed": lambda n: "<a '<b \"<c >" * n,
}


@pytest.mark.parametrize("name", sorted(BROKEN))
def test_time_in_proportion_to_a_page(name):
    seconds = {}
    for n in (25_000, 100_000):
        began = time.time()
        H.extract(BROKEN[name](n))
        seconds[n] = time.time() - began
    assert seconds[100_000] < 8 * seconds[25_000] + 0.5, seconds


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "http://a", "<p>x</p>", "mine", 7)], "page_id long, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in H.main_text(df).collect()] == [(1, "http://a", "x", 1)]
