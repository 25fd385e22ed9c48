import html as html_
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from truegauge.llm.html_text import LABELLED, _judge, article, blocks_of, extract, trained

TREE = trained()
P = "The river rose in the night, and by the morning all the fields were under water."


def test_tree_fits_its_table():
    assert sum(_judge(TREE, r[:-1]) == r[-1] for r in LABELLED) >= len(LABELLED) - 1


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("<p>", ""), ("<!-- all a comment <p>x</p>", ""),
    (f"<html><head><title>T t</title><script>var a='</p>';</script><style>p{{}}</style></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href=/n>News</a></li></ul></nav>"
     f"<!-- ad --><div class='ad'>Buy this now and save a lot of money today.</div><article><h1>A &amp; B</h1><p><b>{P}<br><p>Short.</p><p>x &lt; y&nbsp;z</p></article>"
     f"<footer>&copy; site, all of it. {P}</footer></body></html>", f"A & B\n{P}\nShort.\nx < y z"),
    (f"<body><div id=sidebar><p>{P}</p></div><div class='post-content'><p>{P}</p><form><p>{P}</p><input></form></div><div class='comments'><p>{P}</p></div>", P),
    (f"<article><header><h1>Head line</h1></header><p>{P}</p><section class=\"comments\"><p>{P}</p></section><p>End.</p><footer>by me</footer></article>", f"Head line\n{P}\nEnd."),
    (f"<header class='site'>{P}</header><main><p>{P}\n  {P}</p></main><aside>{P}</aside><div class=\"cookie-notice\">{P}</div>", f"{P} {P}"),
    (f"<div><a href='x'>One</a> <a href='y'>Two</a></div><div>{P}</div><div>{P}</div>", f"{P}\n{P}"),
    (f"<article><p title='a > b'>{P}</p><p>1 < 2 and \"3\"</p><p>{P}</article><footer><p>{P}", f"{P}\n1 < 2 and \"3\"\n{P}"),
    (f"<article><p>{P}</p><script>x</SCRIPT ><p>in<b>li</b>ne</p></article>", f"{P}\ninline"),
])
def test_pages(page, want):
    assert article(page, TREE) == want


LONG = f"<h1>Head line</h1><p>{P} {P}</p><p>{P}</p>"
READ = f"Head line\n{P} {P}\n{P}"


@pytest.mark.parametrize("page,want", [
    *[(f"<body><div class='page {c}'><main><article>{LONG}</article></main></div>", READ) for c in ("has-sidebar", "with-sidebar", "no-sidebar", "social-on", "share-enabled", "comments-open")],
    (f"<div class='has-sidebar'><article>{LONG}</article></div>", READ),
    (f"<section class='has-sidebar'><div class='social-on'><main>{LONG}</main></div></section>", READ),
    (f"<main class='has-sidebar'><article>{LONG}</article></main>", READ),
    (f"<main><div class='has-sidebar'><article>{LONG}</article></div></main>", READ),
    (f"<div class='has-sidebar'><nav><a href=x>{P}</a></nav><main><article>{LONG}<aside>{P}</aside></article></main><div>{P}</div><footer>{P}</footer></div>", READ),
    # Articles that a tag speaks against, comments and teasers stay out.
    (f"<article>{LONG}</article><aside class='x'><article><p>{P}</p></article></aside><footer><main>{P}</main></footer>", READ),
    (f"<nav><article>{LONG}</article></nav><form><main>{LONG}</main></form>", ""),
    (f"<article>{LONG}</article><div id='comments'><article class='comment-body'><p>{P}</p></article></div><section class='related'><article><p>{P}</p></article></section>", READ),
    (f"<div class='has-sidebar'><main><article>{LONG}<div class='comments'><article><p>{LONG * 3}</p></article></div></article><div class='comments'><article><p>{P}</p></article></div></main></div>", READ),
    (f"<div class='has-sidebar'><article>{LONG}</article><div class='comments'><article><p>{P}</p></article><article><p>{P}</p></article></div></div>", READ),
    (f"<div class='entry-content'>{LONG}</div><div id='comments'><article><p>{P}</p></article></div>", READ),
])
def test_wrappers(page, want):
    assert article(page, TREE) == want


WRAPPED = [f"<div class='{outer}'><div {inner}>{LONG}</div></div>" for outer in ("page has-sidebar", "page share-enabled", "no-sidebar", "layout sidebar-left", "hasSidebar", "comments-off wide", "site")
           for inner in ("class='content-area'", "class='content'", "role='main'", "id='story'", "class='entry-text'", "class='x'")]
INNER = [f"<{tag}{outer}><h1>Head line</h1>{part}<p>{P} {P}</p></{tag}>" for tag in ("article", "main") for outer in ("", " class='post'", " id='has-sidebar'")
         for part in (f"<p><a href='x'>{P}</a></p>", f"<ul><li><a href='x'>{P}</a></li></ul>", f"<div><p>{P}</p></div>", f"<table><tr><td>{P}</td></tr></table>", f"<section><blockquote>{P}</blockquote></section>")]


@pytest.mark.parametrize("page", WRAPPED)
def test_names_of_a_state_say_nothing(page):
    assert article(f"<body><nav><ul><li><a href='/'>Home</a></li></ul></nav>{page}<footer>{P}</footer></body>", TREE) == READ


@pytest.mark.parametrize("page", INNER)
def test_all_of_an_article_stays(page):
    """Linked paragraphs and lists included; what a tag or a name speaks against inside it doesn't."""
    extra = f"<nav><a href='y'>{P}</a></nav><div class='share'>{P}</div>"
    for close in ("</article>", "</main>"):
        page = page.replace(close, extra + close)
    assert article(f"<body><header><a href='/'>Site</a></header>{page}<div class='related'><a href='z'>{P}</a></div></body>", TREE) == f"Head line\n{P}\n{P} {P}"


@pytest.mark.parametrize("page,want", [
    *[(f"<body><div><{t}>Menu</div><article>{LONG}</article>", READ) for t in "button object canvas video audio iframe svg".split()],
    (f"<article><p>{P}</p><p>{P} <button>Share this</p><p>{P}</p></article>", f"{P}\n{P}\n{P}"),
    (f"<article>{LONG}<p>Then <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p></article>", f"{READ}\nThen x=2 holds."),
    (f"<article><p>{P}</p><script>x<p>{P}</p></article>", P),
    ("<option>a" * 40_000 + f"<article>{LONG}</article>", READ),
])
def test_unclosed_and_math(page, want):
    assert article(page, TREE) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/!-ap b='\"&;[]x", max_size=80))
def test_never_fails(page):
    blocks_of(page)
    article(page, TREE)


def test_table(spark):
    rows = [(1, "u", f"<article><p>{P}</p></article>", "x"), (1, "u", f"<article><p>{P}</p></article>", "x"), (None, None, None, None), (2, "v", "", "x"), (3, "w", f"<article><p>{P * 3000}</p></article>", "x")]
    got = {(r.page_id, r.url, r.n_chars) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got == {(1, "u", len(P)), (None, None, 0), (2, "v", 0), (3, "w", 3000 * len(P))}
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_generated_pages(spark):
    """Nothing of menus, adverts and footers; the whole article."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in extract(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        words = html_.unescape(re.sub(r"<[^>]*>", " ", inner)).split()
        assert r.text.split() == words
