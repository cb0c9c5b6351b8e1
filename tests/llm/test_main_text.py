"""Minimum cuts against all labellings, page layouts, and pages put together from known parts."""

import itertools
import random

import numpy as np
import pytest

from seriesmill.llm import main_text
from seriesmill.llm.queries import QUERIES


def cost(side, scores, ties):
    wrong = sum(abs(s) for s, content in zip(scores, side, strict=True) if (s < 0) == content and s)
    return wrong + sum(w for a, b, w in ties if side[a] != side[b])


@pytest.mark.parametrize("seed", range(60))
def test_cuts_are_least(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 10)
    scores = [rng.randrange(-6, 7) for _ in range(n)]
    ties = [(rng.randrange(n), rng.randrange(n), rng.randrange(0, 6)) for _ in range(rng.randrange(0, 2 * n))]
    ties = [t for t in ties if t[0] != t[1]]
    best = min(cost(side, scores, ties) for side in itertools.product([False, True], repeat=n))
    for found in (main_text.min_cut(scores, ties), main_text._flow_cut(scores, ties)):
        assert cost(found, scores, ties) == best
    assert main_text.min_cut(scores, ties) == main_text._flow_cut(scores, ties)


def test_neighbours_decide_weak_blocks():
    assert main_text.min_cut([2, -1, 2], [(0, 1, 1), (1, 2, 1)]) == [True] * 3
    assert main_text.min_cut([-2, 1, -2], [(0, 1, 1), (1, 2, 1)]) == [False] * 3
    assert main_text.min_cut([], []) == [] and main_text.min_cut([0], []) == [True]
    chain = [3 if i % 2 else -2 for i in range(20_000)]
    assert main_text.min_cut(chain, [(i, i + 1, 5) for i in range(len(chain) - 1)]) == [True] * len(chain)


PROSE = "The river rose in the night and the lower road was closed until the water fell again."
PARTS = {
    '<nav><a href="/">Home</a> <a href="/b">{}</a></nav>',
    "<header><h2>{}</h2></header>",
    "<footer><p>{}</p></footer>",
    "<aside><p>{}</p></aside>",
    '<div class="sidebar-left"><p>{}</p></div>',
    '<div id="cookie-notice"><p>{}</p></div>',
    '<div class="ad">{}</div>',
    '<div class="AdSlot">{}</div>',
    '<section id="comments"><h3>2 comments</h3><article class="comment"><p>{}</p></article></section>',
    '<ol class="commentlist"><li><p>{}</p></ol>',
    "<form action=x>{}<input value='{}'></form>",
    '<div role="navigation">{}</div>',
    '<script>var a = "<p>{}</p>";</script>',
    "<style>p {{ {} }}</style>",
    "<!-- <p>{}</p> -->",
    "<noscript><p>{}</p></noscript>",
    '<select><option>{}</option></select>',
    '<a title="{}"></a>',
}


@pytest.mark.parametrize("marked", [True, False])
@pytest.mark.parametrize("part", sorted(PARTS))
def test_boilerplate_goes(part, marked):
    begin, end = ('<article class="post">', "</article>") if marked else ('<div class="content">', "</div>")
    article = f"{begin}<h1>A flood</h1><p>{PROSE}</p><p>Short.</p><ul><li>One point of it</li><li>Another point</ul><p>{PROSE}<br>{PROSE}{end}"
    part = part.replace("{}", "Some words that nobody wants to read here").replace("{{", "{").replace("}}", "}")
    wanted = ["A flood", PROSE, "Short.", "One point of it", "Another point", f"{PROSE} {PROSE}"]
    for page in (f"<html><body class=has-sidebar>{part}{article}{part}</body></html>", article + part, part + "<div class='page no-sidebar'>" + article + "</div>"):
        texts, _, content = main_text.labelled(page, main_text.PRIOR)
        assert [t for t, kept in zip(texts, content, strict=True) if kept] == wanted
    if marked:
        inside = article.replace("<p>Short.", part + "<p>Short.")
        texts, _, content = main_text.labelled(inside, main_text.PRIOR)
        kept = [t for t, kept in zip(texts, content, strict=True) if kept]
        assert kept == (["A flood", PROSE, *kept[2:3], *wanted[2:]] if part.startswith("<header") else wanted)


def text_of(html):
    texts, _, content = main_text.labelled(html, main_text.PRIOR)
    return "\n".join(t for t, kept in zip(texts, content, strict=True) if kept)


def test_markup():
    wrap = lambda x: f"<main>{x}</main>"
    assert text_of(wrap("<p>a &lt;b&gt; &amp;amp; &eacute;&#x41;&#66; &nosuch; &am x&nbsp;&nbsp;y")) == "a <b> &amp; éAB &nosuch; &am x y"
    assert text_of(wrap("<p>one<b>two</b> three\n\t four<p>five<hr>six")) == "onetwo three four\nfive\nsix"
    assert text_of(wrap("<table><tr><td>a<td>b<tr><td>c</table>")) == "a b\nc"
    assert text_of(wrap("<p title='x > y' class=\"q>\">in</p> 1 < 2")) == "in\n1 < 2"
    assert text_of(wrap("<P>UP</P><SCRIPT>no</SCRIPT ><p>it's</p>")) == "UP\nit's"
    assert text_of(wrap("<p>a</p><!-- never ends <p>b</p>")) == "a"
    assert text_of(wrap("<p>a</p><script>never ends <p>b</p>")) == "a"
    assert text_of(wrap("<p>a</p></nosuch></ul></><? php ?><!doctype x><p>b")) == "a\nb"
    assert text_of("") == text_of("<p>") == text_of("   \n") == ""
    assert text_of("<nav>" + "<div>" * 3000 + "x") == ""
    assert text_of(wrap('<a href="' + "<p>" * 50_000)) == ""


def test_all_pages(spark, sf_dir, rows_of):
    """The pages of the test tables hold their text in one article each."""
    found = {r.page_id: r for r in QUERIES["op13_main_text"](spark, sf_dir).collect()}
    pages = rows_of("select page_id, url, html from pages")
    assert len(found) == len(pages)
    for page_id, url, html in pages:
        r = found[page_id]
        article = html[html.index("<article>") : html.index("</article>") + 10]
        assert r.url == url and r.text == text_of(article) and r.n_chars == len(r.text)


def test_odd_rows(frame):
    page = f"<nav>Menu</nav><article><h1>Ü</h1><p>{PROSE}</p></article>"
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, None, None), (3, "x", ""), (4, "x", "only words"), (5, "x", "<p>" + "word " * 200_000)]
    table = frame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, text string, block int")
    out = main_text.main_texts(table)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted(map(tuple, out.collect()), key=str)
    text = f"Ü\n{PROSE}"
    assert [r for r in found if r[0] in (1, None)] == sorted([(1, "u", text, len(text))] * 2 + [(None, None, text, len(text))], key=str)
    rest = {r[0]: (r[1], r[2], r[3]) for r in found if r[0] in (2, 3, 5)}
    assert rest[2] == (None, "", 0) and rest[3] == ("x", "", 0) and rest[5][2] == 999_999
    listed = main_text.blocks(table, weights=main_text.PRIOR).where("page_id = 1").collect()
    assert sorted((r.block, r.text, r.content) for r in listed) == sorted([(0, "Menu", False), (1, "Ü", True), (2, PROSE, True)] * 2)
    empty = frame([], "page_id long, url string, html string")
    assert main_text.main_texts(empty).collect() == []
    assert (main_text.fit(empty) == main_text.PRIOR).all()


def test_the_model_separates_held_out_blocks(spark, sf_dir):
    """Fitted on one half of the pages, blocks of the other half are told apart without their place."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    weights = main_text.fit(pages.where("page_id % 2 = 0"))
    assert not np.allclose(weights, main_text.PRIOR)
    right = []
    for r in pages.where("page_id % 2 = 1").collect():
        page = main_text.Page(r.html)
        scores = page.features() @ weights
        right += [(s > 0) == (page.place(i) == 1) for i, s in enumerate(scores) if page.place(i) >= 0]
    assert np.mean(right) > 0.95


def test_the_sample_is_bounded_and_the_order_of_rows_does_not_matter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    one = main_text.fit(pages, fit_pages=20)
    other = main_text.fit(pages.union(pages).repartition(5), fit_pages=20)
    assert (one == other).all() and not (one == main_text.fit(pages)).all()
