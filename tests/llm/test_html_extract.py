"""Main text of hand-written pages, and the minimum cut against trying every labelling."""

import html
import itertools
import random
import re
from pathlib import Path

import pytest

from rungwise.llm.html_extract import content_side, extract_text, main_text
from rungwise.llm.queries import op2_html_extraction

SF = "/root/testdata/sf0.01"

CASES = [
    (None, ""),
    ("", ""),
    ("   \n ", ""),
    ("<html><body><nav><a href=x>Home</a></nav></body></html>", ""),
    ("<article><p>One &amp; two&nbsp;&lt;3&gt;</p><p>A<b>b</b>c<br>d</p></article>", "One & two <3> Abc d"),
    ("<body><header>Site</header><main><h1>Title</h1><p>Text.</p></main><footer>(c)</footer>", "Title Text."),
    ("<div class='sidebar'>x</div><div class=content><p>Body</p><div class='related-posts'>no</div></div>", "Body"),
    ("<article><p>a<p>b<ul><li>c<li>d</ul><section class='comments'><article><p>no</p></article></section></article>", "a b c d"),
    ("<article>a<script>if (1 < 2) '<p>no</p>'</script><style>p{}</style><!-- no <p> -->b</article>", "ab"),
    ("<article><p>a</p><form><label>no</label><input></form><div id=cookieNotice>no</div><p>z</p></article>", "a z"),
    ("<article><p title=\"a > b\">x</p><aside>no</aside><div role='navigation'>no</div></article>", "x"),
    ("<article><p>text <span class=\"ad\">no</span> more</p></article>", "text more"),
    ("<nav><ul><li>menu<article><p>kept</p></article>", "kept"),
    ("<article><p>a</p><script>never closed <p>b</p>", "a"),
    ("<article>a < b and c > d &unknown; &#233;&#x41;</article>", "a < b and c > d &unknown; éA"),
    ("<table><tr><td>" + "A long cell that reads like prose. It has sentences. " * 3 + "</table><div><a href=1>x</a> <a href=2>y</a></div>", ("A long cell that reads like prose. It has sentences. " * 3).strip()),
]


@pytest.mark.parametrize("page, text", CASES)
def test_main_text(page, text):
    assert main_text(page) == text


PROSE = "This is a long paragraph of plain prose that any reader would call the text. It goes on for a while, without a link. It has sentences. And then it ends, after some more words that make it longer than a notice would ever be, or so one hopes. " * 2
SAME_PAGE = [
    ('<article class="post category-social"><p>Yes.</p></article>', "Yes."),
    ('<main class="has-comments"><p>Yes.</p></main>', "Yes."),
    ('<div role="main" class="widget"><p>Yes.</p></div>', "Yes."),
    ('<div class="layout with-sidebar"><article><p>Yes.</p></article></div>', "Yes."),
    ('<div class="sidebar-left"><article><p>Yes.</p></article></div>', "Yes."),
    ('<div class="ad">Buy<article><p>Yes.</p></article>', "Yes."),
    ("<aside>Buy<article><p>Yes.</p></article>", "Yes."),
    ("<aside>Buy<article><p>No.</p></article></aside><main><p>Yes.</p></main>", "Yes."),
    ('<form id="aspnetForm"><div class="menu">Home</div><article><p>Yes.</p></article></form>', "Yes."),
    ("<form><div><p>" + PROSE + "</p></div></form>", PROSE.strip()),
    ("<form><label>Name</label><input></form><article><p>Yes.</p></article>", "Yes."),
    ('<div class="left-sidebar"><h1>Title</h1><p>' + PROSE + '</p></div><div class="sidebar">Some other text.</div>', "Title " + PROSE.strip()),
    ('<article><p>Yes.</p><div class="promo">Buy it. Now.</div><div class="related"><article><p>No.</p></article></div></article>', "Yes."),
    ('<main><article><p>Yes.</p></article><article class="comment"><p>No.</p></article></main>', "Yes."),
    ('<div class="sidebar"><article><a href="x">A teaser that is a link</a></article></div><article><p>Yes.</p></article>', "Yes."),
    ('<div class="post-comments"><article><p>No.</p></article></div><article><p>Yes.</p></article>', "Yes."),
]


@pytest.mark.parametrize("page, text", SAME_PAGE)
def test_class_words_and_unclosed_elements_do_not_hide_an_article(page, text):
    assert main_text(page) == text


LONG = f"<p>{PROSE}</p>"
SHORT_BLOCKS = [
    "<p>Yes.</p><p>No.</p><p>Why?</p>",
    "<ul>" + "".join(f"<li>Eggs {i}</li>" for i in range(60)) + "</ul>",
    "<table>" + "".join(f"<tr><td>a{i}</td><td>{i}</td></tr>" for i in range(60)) + "</table>",
    "<div><div>x = 1</div><div>y</div></div>",
]


@pytest.mark.parametrize("short", SHORT_BLOCKS)
def test_short_blocks_stay_in_unmarked_text(short):
    menu = "<div>" + "".join(f"<div><a href={i}>Link {i}</a></div>" for i in range(9)) + "</div>"
    plain_text = lambda x: " ".join(re.sub("<[^>]*>", " ", x).split())
    page = LONG + short + LONG
    assert main_text(menu + page + menu) == plain_text(page)
    assert main_text(menu + "<div>Menu</div>" + menu) == ""


def test_formulas_are_text():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold.</p><math><semantics><mi>y</mi><annotation>\\y</annotation></semantics></math></article>"
    assert main_text(page) == "Let x=1 hold. y"
    assert main_text("<article><math><mtable><mtr><mtd>1</mtd><mtd>2</mtd></mtr></mtable></math></article>") == "1 2"


def test_long_and_broken_pages():
    assert main_text("<article>" + "<div>" * 3000 + "deep" + "</p>" * 3000).endswith("deep")
    assert main_text("<article>" + "<p>w" * 20000).count("w") == 20000
    main_text("<a '" * 3000 + "<" * 5000 + "&" * 5000 + "<!--")


def cost(labels, scores, edges):
    total = sum(max(s, 0) for s, k in zip(scores, labels) if not k) + sum(max(-s, 0) for s, k in zip(scores, labels) if k)
    return total + sum(w for a, b, w in edges if labels[a] != labels[b])


def test_cut_is_least_of_all_labellings():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randint(1, 9)
        scores = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(i - 1, i, rng.randint(1, 6)) for i in range(1, n)]
        edges += [(*sorted(rng.sample(range(n), 2)), rng.randint(1, 5)) for _ in range(rng.randint(0, 4)) if n > 2]
        best = min(cost(labels, scores, edges) for labels in itertools.product([False, True], repeat=n))
        assert cost(content_side(scores, edges), scores, edges) == best


def test_rows(spark):
    rows = [(1, "u", CASES[4][0], "x", 1), (1, "u", CASES[4][0], "x", 1), (None, None, None, None, None), (2, "v", "<p>" + "w " * 100_000, "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((tuple(r) for r in extract_text(pages).collect()), key=repr)
    assert got == sorted(((p, u, main_text(h), len(main_text(h))) for p, u, h, *_ in rows), key=repr)
    assert extract_text(pages.limit(0)).count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_given_pages_give_their_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op2_html_extraction(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        inside = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", pages[r.page_id], re.S)[1]
        plain = " ".join(html.unescape(re.sub(r"<(/?(?:p|h1|br))\b[^>]*>", " ", inside).replace("<b>", "")).split())
        assert r.text == plain and r.n_chars == len(plain)
