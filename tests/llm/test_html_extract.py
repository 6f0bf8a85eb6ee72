"""HTML extraction: hand-made pages, and the minimum cut against all labellings."""
import itertools

import numpy as np
import pytest

from tollgate.llm import common, html_extract
from tollgate.llm.html_extract import blocks, main_text, minimum_cut


def test_article_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
    <header class="site"><h1>Site</h1><a href=/>Home</a></header><nav><ul><li><a>One</a></ul></nav><div id="cookie-notice">We use cookies.</div>
    <article><header><h1>Title &amp; more</h1></header><p>First  para&shy;graph<br>goes <b>on</b>.<div class="advert">Buy!</div>
    <p>Caf&eacute; &#x41;&lt;b&gt;<ul><li>one<li>two</ul><form><label>Mail</label><input></form>
    <section class="comments"><p>Great post, I really liked reading it, thanks a lot.</p></section></article>
    <aside><p>Aside that is long enough to be a paragraph, really.</p></aside><footer>&copy; 2020</footer></body>"""
    text, _, _ = main_text(page)
    assert text == "Title & more\nFirst para­graph goes on.\nCafé A<b>\none\ntwo"


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("<nav>menu</nav>", ""), ("<article></article>", ""),
    ("<article><p>a<p>b</article>", "a\nb"), ("<article><p>open <!-- never closed", "open"),
    ("<article><table><tr><td>x<td>y<tr><td>z</table></article>", "x y\nz"),
    ("<article>1 < 2 and <b>3</article><footer>f</footer>", "1 < 2 and 3"),
    ("<div class=sidebar-layout><article><p>Only article.</p></article></div>", "Only article."),
    ("<article><p>kept</p><p hidden>gone</p><noscript>no</noscript><textarea>t</textarea></article>", "kept")])
def test_small_pages(page, want):
    assert main_text(page)[0] == want


@pytest.mark.parametrize("page,want", [
    ("<article><p>a <svg class=icon /> b</p><p>c</p></article>", "a b\nc"),
    ("<article><p>a <svg/> b</p><p>c <svg viewBox='0 0=1'/> d</p><p>e <svg><path d=''/>x</svg> f</p></article>", "a b\nc d\ne f"),
    ("<article><p>a <svg class=icon/>x</svg> b</p></article>", "a b"),  # the slash is the value's
    ("<article><p>a <svg><title>t<p>u</p></title><svg/><svg>x</svg>y</svg> b</p></article>", "a b"),
    ("<article><p>a <svg><path></p><p>b</p><p>c <svg><g></article><footer>f</footer>", "a\nb\nc"),
    ("<article><p>a <svg><style><![CDATA[ <p> ]]></style></svg> b</p></article>", "a b"),
    ("<article><p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then <math/> stop.</p><p>c</p></article>", "If x=2 then stop.\nc"),
    ("<article><p><math><mtable><mtr><mtd>1</mtd><mtd>0</mtd></mtr></mtable></math></p></article>", "1 0"),
    ("<article><p><math><semantics><mi>y</mi><annotation encoding='application/x-tex'>\\\\y</annotation></semantics></math> z</p></article>", "y z"),
    ("<article><p><math><mi>y</mi><annotation>w</math> z</p><p>c</p></article>", "yw z\nc")])
def test_drawings_and_formulas(page, want):
    assert main_text(page)[0] == want


PAGES = ["<nav><a>Home</a></nav><div class=ad>Buy now</div><article><h1>A title here</h1><p>Some words of a text, and more of them. They end here.</p>"
         "<p>Another part of the text follows, with its own words.</p></article><footer>Imprint 2020</footer>"] * 5
TEXT = "<p>Here the text says what was found, and by whom. It ends here.</p>"


@pytest.mark.parametrize("name", ["related-work", "search-methods", "social-history", "following-the-notice", "search", "public-comments"])
@pytest.mark.parametrize("model", [None, html_extract.train(PAGES)])
def test_names_made_of_headings_lose_nothing(name, model):
    for page in (f"<article>{TEXT}<h2 id={name}>A heading</h2>{TEXT}{TEXT}</article>", f"<article>{TEXT}<section id='{name}'><h2>A heading</h2>{TEXT}</section>{TEXT}</article>",
                 f"<article>{TEXT}<div id='{name}-of-it'><h2>A heading</h2>{TEXT}</div>{TEXT}</article>", f"<article class='post category-{name}'>{TEXT}<h2>A heading</h2>{TEXT}</article>",
                 f"<div id=content>{TEXT}<h2 id={name}>A heading</h2>{TEXT}</div>"):
        found = blocks(page)
        assert main_text(page, model)[0] == "\n".join(b.text for b in found)


@pytest.mark.parametrize("part", ["<div class='related-posts'><p>See also this fine text, it is long.</p></div>", "<p class=advert>Buy it now, it is cheap.</p>", "<section id=comments>" + TEXT + "</section>",
                                  "<ul id='related-links-list'><li><a>One</a><li><a>Two</a><li><a>Three</a><li><a>Four</a><li><a>Five</a></ul>", "<div role=navigation>" + TEXT + "</div>",
                                  "<div id=newsletter-signup>" + TEXT + "</div>"])
def test_named_parts_of_an_article_are_cut(part):
    kept = f"<article>{TEXT}{TEXT}"
    assert main_text(f"{kept}{part}</article>")[0] == main_text(kept)[0]


def test_names_outside_an_article():
    for part in (f"<section id=comments>{TEXT}</section>", f"<table><tr><td id=sidebar>{TEXT}</table>", f"<div id=related-posts>{TEXT}</div>"):
        assert main_text(f"<div id=content>{TEXT}{TEXT}</div>{part}")[0] == main_text(TEXT + TEXT)[0]
    assert main_text(f"<div class=has-sidebar id=search><article><h2>Two words</h2>{TEXT}<ul><li>1<li>2</ul></article></div>")[0].count("\n") == 3


def test_minimum_cut_is_least_cost():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        odds, parents = rng.normal(0, 1.5, n), rng.integers(0, 3, n).tolist()
        edges = [(i - 1, i, 0.6) for i in range(1, n)]
        for i, p in enumerate(parents):
            before = [j for j in range(i) if parents[j] == p]
            if before:
                edges.append((before[-1], i, 0.8))

        def cost(label):
            return sum(max(v, 0) if not k else max(-v, 0) for v, k in zip(odds, label)) + sum(w for a, b, w in edges if label[a] != label[b])

        best = min(cost(label) for label in itertools.product([False, True], repeat=n))
        assert cost(minimum_cut(odds, parents).tolist()) == pytest.approx(best)


def test_long_page_is_linear():
    page = "<body>" + "<div>" * 300 + "<article>" + "<p>Some words here.</p>" * 3000 + "</article>"
    assert main_text(page)[0].count("\n") == 2999
    assert len(blocks("<p>" * 5000 + "x")) == 1


def test_table(spark):
    common.prepare(spark)
    rows = [(1, "u", "<article><p>Hello there, reader.</p></article><footer>f</footer>"), (2, None, None), (1, "u", "<article><p>Hello there, reader.</p></article><footer>f</footer>"), (None, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_extract.extract(df).collect()), key=str)
    assert got == sorted([(1, "Hello there, reader.", 20), (1, "Hello there, reader.", 20), (2, "", 0), (None, "", 0)], key=str)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_driver_pages(spark, sf_small):
    """In the given pages the article is what its element holds."""
    import html as h
    import re
    common.prepare(spark)
    pages = common.table(spark, sf_small, "pages")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        parts = re.sub(r"</?(?:p|h1)>", "\x00", re.sub(r"</?b>", "", body)).split("\x00")
        assert got[r.page_id] == "\n".join(x for x in (" ".join(h.unescape(p).split()) for p in parts) if x)


@pytest.mark.parametrize("page,want", [
    ("<p>one <SPAN hidden>x</SPAN> two</p><p>three.</p>", "one two\nthree."),
    ("<p>one <span hidden>x</p><p>two, three.</p>", "one\ntwo, three."),
    ("<p>a <span hidden>a<span>b</span> secret</span> z, y.</p>", "a z, y."),
    ("<p>a <span aria-hidden=true>i</span>b <em style='display:none'>c<em>d</em>e</em>f, g.</p>", "a b f, g."),
    ("<p>a <span class=hidden-gem>kept</span> and <span data-x=none>this</span>.</p>", "a kept and this.")])
def test_hidden_inline_elements(page, want):
    assert main_text(f"<article>{page}</article>")[0] == want


LINKS = "<p><a href=a>One fine thing to buy today</a></p><p><a href=b>Another thing that is on sale</a></p><p><a href=c>A third thing, cheap</a></p>"


@pytest.mark.parametrize("model", [None, html_extract.train(PAGES)])
def test_the_cut_decides_about_links_in_an_article(model):
    kept = main_text(f"<article>{TEXT}{TEXT}</article>", model)[0]
    page = f"<article>{TEXT}<div>{LINKS}</div>{TEXT}</article>"
    found = blocks(page)
    odds = html_extract.log_odds(found, model)
    assert main_text(page, model)[0] == kept and (odds < 0).any()  # an unnamed advert of links goes
    alone = f"<article>{TEXT}<p><a href=s>The source of this text</a></p>{TEXT}</article>"
    text, n, k = main_text(alone, model)
    assert n == k == 3  # one linked line between paragraphs stays with them, whatever its own odds
    lists = f"<article>{TEXT}<ul><li>red<li>green<li>blue<li>grey</ul>{TEXT}</article>"
    assert main_text(lists, model)[0].count("\n") == 5
    assert main_text(f"<article>{TEXT}<div class=reviews>{TEXT}</div>{TEXT}</article>", model)[0] == kept


def test_pages_without_names(spark, sf_small):
    """The given pages with every name taken away: classifier and cut alone find most of the article."""
    import re
    pages = [r.html for r in common.table(spark, sf_small, "pages").collect()]
    model = html_extract.train(pages[: len(pages) // 2])
    right = total = 0
    for page in pages[len(pages) // 2 :]:
        truth = [b.element.main and not b.element.bad for b in blocks(page)]
        plain = re.sub(r"<(/?)(?:article|nav|aside|footer|header|main|section)\b", r"<\1div", re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page))
        found = blocks(plain)
        keep = minimum_cut(html_extract.log_odds(found, model), [b.parent for b in found])
        if len(found) == len(truth):
            right += sum(bool(a) == bool(b) for a, b in zip(truth, keep))
            total += len(truth)
    assert total > 100 and right / total > 0.9
