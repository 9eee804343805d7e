"""HTML extraction: single pages by hand, sites against a brute-force count over made trees."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlstone.llm import html_extract

PAGE = '<!DOCTYPE html><html><head><title>t</title><script>var x="<p>";</script></head><body><nav><ul><li><a href="/a">a</a></li></ul></nav>{}<footer>&copy; f</footer></body></html>'


@pytest.mark.parametrize(
    "page,want",
    [
        (PAGE.format("<article><h1>T &amp; U</h1><p><b>one<br>two<p>three\n  &nbsp; four</p></article>"), "T & U\none two\nthree four"),
        (PAGE.format('<div class="ad">buy</div><article><p>x<p>y &lt;b&gt;</article><section id="comments">bad</section>'), "x\ny <b>"),
        (PAGE.format("<main><aside>no</aside><p>a</p><form><p>f</p></form><div class='share-bar social'>s</div><ul><li>b<li>c</ul></main>"), "a\nb\nc"),
        ("<body><h2>no article</h2>text <i>in</i>line<div class='cookie-notice'>c</div><!-- open", "no article\ntext inline"),
        ("<article><p>cut &am", "cut &am"), ("<article><p>cut <p cla", "cut"), ("plain", "plain"), ("", ""), (None, ""), ("<article></article>", ""), ("a < b and c > d", "a < b and c > d"),
        ("<article><div class='post-header'><h1>T</h1></div><header><h2>S</h2></header><p>x</p></article><div class='page-header'>no</div>", "T\nS\nx"),
        ('<article class="has-sidebar"><p title="a>b">q</p></article>', "q"), ("<article><p>a</p><article class='comment'>c</article></article>", "a"), ("<article><pre>x\n y</pre><table><tr><td>1<td>2</table></article>", "x y\n1\n2"),
    ],
)
def test_main_text(page, want):
    assert html_extract.main_text(page, set()) == want


def test_site_templates(spark):
    body = "<body><div>Welcome to our site</div><div><p>own {0}</p></div><p>seen often</p><div>bye</div></body>"
    rows = [(k, f"http://A.example/{k}", body.format(k)) for k in range(4)] + [(10 + k, f"https://b.example:80/{k}", body.format(k)) for k in range(3)] + [(20 + k, None, body.format(k)) for k in range(5)] + [(30, "http://a.example/x", None), (None, "http://a.example/y", "<p>z</p>")]
    rows += [(40 + k, "http://c.example/", f"<h2>{k}</h2><article><p>same text</p><ul><li><a href=1>more</a></li></ul></article>") for k in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("gone", F.lit(1))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert [got[k] for k in range(4)] == [f"own {k}" for k in range(4)]
    assert got[10] == "Welcome to our site\nown 0\nseen often\nbye" and got[20] == got[10] and got[30] == "" and got[None] == "z"
    assert {got[40 + k] for k in range(5)} == {"same text"}
    assert html_extract.extract(df.where("false")).count() == 0


def test_site_templates_inside_the_article(spark):
    box = "<div>Read us <p>every day</p></div>"
    rows = [(k, "http://a.example/", f"<main>{box}<article><h1>T</h1><p>own {k}</p>{box}<p>often</p><section>part {k}</section></article></main>") for k in range(4)]
    rows += [(10 + k, "http://b.example/", f"<article><p>own {k}</p>{box}</article>") for k in range(3)]  # on too few
    rows += [(20 + k, "http://c.example/", f"<main><p>{k}</p><article><p>same</p>{box}</article></main>") for k in range(5)]  # one article, repeated
    rows += [(30 + k, "http://d.example/", f"<article><h1>T {k}</h1>{box}</article>") for k in range(5)]  # only headings would be left
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"].split("\n") for r in html_extract.extract(df).collect()}
    for k in range(5):
        if k < 4:
            assert got[k] == ["T", f"own {k}", "often", f"part {k}"]
        if k < 3:
            assert got[10 + k] == [f"own {k}", "Read us", "every day"]
        assert got[20 + k] == [str(k), "same", "Read us", "every day"] and got[30 + k] == [f"T {k}", "Read us", "every day"]


@pytest.mark.parametrize(
    "inner,want",
    [
        ('<section class="social-history"><p>kept</p></section>', "kept"), ('<section id="related"><p>Kept too.</p></section>', "Kept too."), ('<div id="related"><a href=1>links</a></div>', ""), ('<div class="related-posts"><p>gone</p></div>', ""),
        ('<div class="cookieBanner">gone</div>', ""), ('<div class="noticeable">kept</div>', "kept"), ('<div class="newsletter-signup">gone</div>', ""), ('<section class="informed-consent">kept</section>', "kept"), ('<section class="navigation-history">kept</section>', "kept"), ('<ins class="adsbygoogle">gone</ins>', ""), ('<div class="comment-body">gone</div>', ""), ('<div class="site-notice-2">gone</div>', ""), ('<p class="hidden-mobile">kept</p>', "kept"), ('<div class="bread-crumbs">gone</div>', ""),
    ],
)
def test_names_inside_the_article(inner, want):
    assert html_extract.main_text(f"<main><p>a</p>{inner}</main>", set()).split("\n") == ["a", want][: 1 + bool(want)]


@pytest.mark.parametrize("name", ['id="cookies"', 'id="pagination"', 'id="comments"', 'id="navigation"', 'class="modal"', 'class="newsletter"', 'class="comment"'])
def test_sections_of_an_article_about_such_things(name):
    inner = f"<section {name}><h2>Title</h2><p>Mix butter and sugar.</p></section>"
    assert html_extract.main_text(f"<article><p>a</p>{inner}</article>", set()) == "a\nTitle\nMix butter and sugar."
    assert html_extract.main_text(f"<article><p>a</p><div {name}><a href=1>one</a> <a href=2>two</a></div></article>", set()) == "a"
    assert html_extract.main_text(f"<p>a</p>{inner}", set()) == "a"


def test_reader_comments_inside_the_main_part():
    one, kept = '<div class="comment"><b>Ann</b><p>Nice.</p></div>', "<p>a</p>"
    for talk in (f'<section id="comments"><h2>2 comments</h2>{one}{one}</section>', f'<div class="comments"><ul><li class="comment">x</ul></div>', one + one, '<div class="comment-list"><p>x</p></div>', f'<div id="comments"><div><div class="comment">x</div></div></div>'):
        assert html_extract.main_text(f"<main>{kept}{talk}</main>", set()) == "a"


def test_counts_change_article_pages(spark):
    """Sections that a site repeats in its articles go by the counts, whatever they are called."""
    box = '<section id="cookies"><p>We use cookies, says every page.</p></section>'
    rows = [(k, "http://a.example/", f"<article><h1>T {k}</h1><p>own {k}</p>{box}</article>") for k in range(6)] + [(9, "http://b.example/", f"<article><h1>T</h1><p>own</p>{box}</article>")]
    assert texts_of(spark, rows) == [f"T {k}\nown {k}" for k in range(6)] + ["T\nown\nWe use cookies, says every page."]


def test_long_and_broken_pages():
    n = 100_000
    began = time.time()
    assert html_extract.main_text("<div>" * n + "</span>" * n + "x", set()) == "x"
    assert html_extract.main_text("<span><main>" + "<b>" * n + "</span>" * n + "x", set()) == "x"
    assert html_extract.main_text("<p>word " * n, set()).count("\n") == n - 1
    assert time.time() - began < 30


def texts_of(spark, rows, **more):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return [r["text"] for r in html_extract.extract(df, **more).orderBy("page_id").collect()]


def test_copies_of_a_page_are_one_page(spark):
    page = "<div><p>one</p></div><p>two</p>"
    assert texts_of(spark, [(k, "http://a.example/", page) for k in range(4)]) == ["one\ntwo"] * 4
    assert texts_of(spark, [(7, "http://a.example/", page)] * 5) == ["one\ntwo"] * 5
    # scripts and attributes are not shown: still one page
    assert texts_of(spark, [(k, "http://a.example/", f"<script>{k}</script>{page.replace('<p>', f'<p id=x{k}>')}") for k in range(6)]) == ["one\ntwo"] * 6
    # a page made of nothing but what its site repeats keeps it
    rows = [(k, "http://a.example/", f"{page}<p>own {k}</p>") for k in range(4)] + [(9, "http://a.example/", page)]
    assert texts_of(spark, rows) == [f"own {k}" for k in range(4)] + ["one\ntwo"]


def test_a_subtree_needs_a_share_of_the_site(spark):
    rows = [(k, "http://a.example/", f"<p>own {k}</p>" + "<div>quoted by few</div>" * (k < 5)) for k in range(200)]
    assert texts_of(spark, rows)[4] == "own 4\nquoted by few"
    assert texts_of(spark, rows, min_share=0.02)[4] == "own 4"


def test_null_and_repeated_ids(spark):
    rows = [(None, "http://a.example/", f"<div>menu</div><p>own {k}</p>") for k in range(4)] + [(3, "http://a.example/", f"<div>menu</div><p>own {k}</p>") for k in range(4, 6)]
    assert sorted(texts_of(spark, rows)) == [f"own {k}" for k in range(6)]


def show(tree):
    tag, *parts = tree
    return f"<{tag}>{''.join(p if isinstance(p, str) else show(p) for p in parts)}</{tag}>"


def walk(tree, above=()):
    yield tree, above
    for p in tree[1:]:
        if not isinstance(p, str):
            yield from walk(p, (*above, tree))


def blocks_of(tree, gone):
    if tree in gone:
        return []
    out = []
    for p in tree[1:]:
        out += [p] if isinstance(p, str) else blocks_of(p, gone)
    return out


def size(tree):
    return sum(len(p) if isinstance(p, str) else size(p) for p in tree[1:])


def text_beside(article, box):
    """Whether the article has more than headings besides one such box; if not, the box is no box."""
    return size(article) - sum(size(x) for x, _ in walk(article) if x[0] == "h1") > size(box)


def brute_sites(pages, least=4, share=0.05):
    """The texts of (host, tree) with every subtree compared as a whole."""
    out = []
    for host, page in pages:
        shown = {t for h, t in pages if h == host}
        enough = max(least, share * len(shown))
        by_page = Counter(x for t in shown for x in {x for x, above in walk(t) if x[0] != "body" and not any(a[0] == "article" for a in (*above, x))})
        by_article = Counter(x for x, _ in {(x, above[1]) for t in shown for x, above in walk(t) if x[0] == "div" and len(above) > 1 and above[1][0] == "article" and text_beside(above[1], x)})
        article = next((x for x, _ in walk(page) if x[0] == "article"), None)
        gone = {x for x, n in (by_article if article else by_page).items() if n >= enough}
        main = article or page
        if article:
            gone = {x for x in gone if text_beside(article, x)}
        out.append("\n".join(blocks_of(main, gone) or blocks_of(main, ())))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_sites_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pages = []
    for host in range(6):
        boxes = [("div", f"box {host} {k}", ("p", f"inner {host} {k % 2}")) for k in range(6)] + [("p", f"line {host} {k}") for k in range(3)]
        for k in range(rng.choice([3, 12, 40])):
            own = [("p", f"own {host} {k if rng.random() < 0.8 else 0} {j}") for j in range(rng.randrange(3))]
            parts = [rng.choice(boxes) for _ in range(rng.randrange(4))] + own
            rng.shuffle(parts)
            if host % 2:
                parts = [rng.choice(boxes), ("article", ("h1", f"title {k}"), *parts), rng.choice(boxes)]
            pages.append((f"h{host}", ("body", *parts)))
    rows = [(k, f"https://{h}.example/{k}", show(t)) for k, (h, t) in enumerate(pages)]
    assert texts_of(spark, rows) == brute_sites(pages)
