"""Main text of pages, the cut against all labellings, odd html."""

import itertools
import random

import pytest

from affectlake.llm import html_extract as H
from affectlake.llm.html_blocks import blocks_of, is_boiler
from affectlake.llm.min_cut import content_side

LONG = "This is a long sentence of the article with many words in it. And here is another one, longer still."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies. Accept?</div><!-- ad --><div class="ad">Buy &amp; save</div>
<article><h1>Title &eacute;&#8217;s &lt;b&gt;</h1><p>{LONG}<p>Short<b>er</b>.<br>two&nbsp;three
  four<div class="advert">Inside ad</div><form>Name <input></form><ul><li>point one</li></ul><p>{LONG}</article>
<aside>Side</aside><section id="comments"><p>{LONG} says a reader.</p></section><footer>&copy; me</footer></body></html>"""


def texts(spark, pages, weights=tuple(H.PRIOR)):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").selectExpr("*", "'x' as text")
    return [r.text for r in H.extract(df, list(weights)).select("row.page_id", "text").orderBy("page_id").collect()]


def test_article_without_the_rest(spark):
    df = spark.createDataFrame([(i, PAGE) for i in range(20)], "page_id long, html string")
    want = f"Title é’s <b> {LONG} Shorter. two three four point one {LONG}"
    assert texts(spark, [PAGE], H.fit(df)) == [want]
    assert texts(spark, [PAGE]) == [want]


def test_form_alone_decides_on_bare_pages(spark):
    bare = f"<body><div><a href=a>Home</a> <a href=b>News</a></div><div><p>{LONG}</p><p>{LONG}</p></div>" \
           "<div><a href=c>Imprint</a></div></body>"
    df = spark.createDataFrame([(i, PAGE) for i in range(20)], "page_id long, html string")
    assert texts(spark, [bare], H.fit(df)) == [f"{LONG} {LONG}"]


@pytest.mark.parametrize("html,want", [
    (None, ""), ("", ""), ("   ", ""), ("<article></article>", ""), (f"<article><p>{LONG}</p><p cla", LONG),
    (f"<article>{LONG} &am", f"{LONG} &am"), (f"<article>{LONG}<script>x<p>", LONG),
    (f"<article><p hidden>no</p>{LONG}</article>", LONG), (f"<article></p></div>{LONG} 1 < 2</b>", f"{LONG} 1 < 2"),
])
def test_odd_html(spark, html, want):
    assert texts(spark, [html, html]) == [want, want]


def test_long_page_and_empty_table(spark):
    page = "<article>" + f"<p>{LONG}</p>" * 3_000
    assert texts(spark, [page]) == [" ".join([LONG] * 3_000)]
    assert texts(spark, []) == []
    empty = spark.createDataFrame([], "page_id long, html string")
    assert H.fit(empty) == H.PRIOR


@pytest.mark.parametrize("start,end", [
    ('<div class="long-form story">', "</div>"), ('<div class="post no-comments">', "</div>"),
    ('<div class="entry-content share-enabled">', "</div>"), ('<form id="aspnet"><div class="content">', "</div></form>"),
    ('<div class="story promo">', "</div>"),
])
def test_names_do_not_take_the_article(spark, start, end):
    body = f"{start}<p>{LONG}</p><p>{LONG}</p>{end}"
    page = f"<body><nav><a href=x>Home</a></nav>{body}<div class=footer>Imprint of the site.</div></body>"
    assert texts(spark, [page]) == [f"{LONG} {LONG}"]


def test_names_of_boilerplate_are_believed_beside_an_article(spark):
    comments = f'<section id="comments"><div class="comment-content"><p>{LONG} {LONG}</p></div></section>'
    assert texts(spark, [comments, f"<div><p>{LONG}</p></div>{comments}"]) == ["", LONG]
    related = f'<aside><div class="post"><p>{LONG} {LONG}</p></div></aside>'
    assert texts(spark, [f"<main><p>{LONG}</p></main>{related}"]) == [LONG]


def test_deep_nesting_takes_linear_steps():
    pages = ["<div>" * n + "x" + "</div>y" * n for n in (1_000, 3_000)]
    assert [len(blocks_of(page)) for page in pages] == [1_001, 3_001]
    deep = blocks_of("<div class=ad>" + "<div>" * 500 + "in" + "</div>" * 501 + "<a>out</a>")
    assert [(b.boiler, b.linked) for b in deep] == [(True, 0), (False, 3)]


def test_block_places():
    one, two = blocks_of("<div><p>a <a>b</a><p>c</div>")
    assert (one.text, one.linked, two.text) == ("a b", 1, "c")
    assert one.path[:1] == two.path[:1] and one.path != two.path


def test_cut_is_the_least_of_all_labellings():
    r = random.Random(4)
    for _ in range(60):
        n = r.randint(1, 8)
        content, boiler = ([r.random() * 3 for _ in range(n)] for _ in range(2))
        edges = [(i, j, r.random()) for i, j in itertools.combinations(range(n), 2) if r.random() < 0.5]

        def cost(kept, content=content, boiler=boiler, edges=edges):
            own = sum(c if k else b for k, c, b in zip(kept, content, boiler, strict=True))
            return own + sum(w for i, j, w in edges if kept[i] != kept[j])

        best = min(cost(k) for k in itertools.product([False, True], repeat=n))
        assert cost(content_side(content, boiler, edges)) == pytest.approx(best)


@pytest.mark.parametrize("tag,names,boiler", [
    ("div", "main-nav", True), ("div", "article-header", False), ("div", "site-header", True), ("header", "", True),
    ("header", "entry-header", False), ("div", "content with-sidebar", False), ("div", "main-sidebar", True),
    ("article", "comment-body", True), ("article", "post related", False), ("div", "post-comments", True),
    ("div", "article-footer", True), ("body", "has-sidebar menu", False), ("div", "reading", False),
])
def test_names_of_elements(tag, names, boiler):
    assert is_boiler(tag, {"class": names}) is boiler
