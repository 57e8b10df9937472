"""Main text of pages: blocks, gradients, and what the trained network keeps and drops."""

import html as markup
import random
import re

import numpy as np
import pytest

from catalogspark.llm import extract

SF = "/root/testdata/sf0.001"


def article_text(page):
    """The article of the tables' pages, by plain substitution: their markup is regular."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(markup.unescape(re.sub(r"</?b>|<br>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(b for b in blocks if b)


@pytest.fixture(scope="module")
def model(spark):
    return extract.learned(extract.sample_pages(spark.read.parquet(f"{SF}/pages.parquet")))


def kept(model, page):
    blocks = extract.leaf_blocks(page)
    x = extract.inputs([blocks])
    if not blocks.texts:
        return []
    _, score, _ = extract.scores(model, x, np.array([0]))
    return [t for t, s in zip(blocks.texts, score) if s >= 0.5]


def test_blocks_of_broken_markup():
    def texts(page):
        return extract.leaf_blocks(page).texts

    assert texts(None) == texts("") == texts("<p> \n </p>") == []
    assert texts("<p>a &amp; b&nbsp;c<p>d<br>e <b>f</b>g") == ["a & b c", "d e fg"]
    assert texts("x<script>var a = '<p>no</p>'</script>y<style>p{}</style><!-- <p>no --><div>z</div>") == ["xy", "z"]
    assert texts("a<!-- open <p>never") == ["a"] and texts("a<script>open <p>never") == ["a"] and texts("a <p title='x") == ["a"]
    assert texts("<title>t</title><ul><li>1<li>2<ul><li>3</ul><li>4</ul><table><tr><td>5<td>6<tr><td>7</table>") == list("1234567")
    assert texts("1 < 2 &lt;p&gt; <textarea>no</textarea>") == ["1 < 2 <p>"]
    assert texts("<p title=\"a>b\">x</p></div></p>y") == ["x", "y"]
    blocks = extract.leaf_blocks('<nav class="topMenu main-nav"><a href=x>Home</a></nav><article><p>t</article>')
    assert {"nav", ".top", ".menu", ".main", ".nav", "a"} >= blocks.names[0] - {"a"} and blocks.linked == [1.0, 0.0]
    assert blocks.names[1] == {"article", "p"}
    deep = extract.leaf_blocks("<b>" * 20_000 + "<div>" * 20_000 + "x")
    assert deep.texts == ["x"] and len(deep.paths[0]) < 10


def test_slopes_against_differences():
    rng = random.Random(1)
    pages, labels = [], []
    for _ in range(4):
        page, made = extract.laid_out(["alpha beta.", "gamma delta", "epsilon"], ["short one", "another bit of text"], rng)
        blocks = extract.leaf_blocks(page)
        assert len(blocks.texts) == len(made)
        pages.append(blocks)
        labels.extend(made)
    x, y = extract.inputs(pages), np.array(labels)
    y[0] = -1
    p = {k: v.astype(np.float64) for k, v in extract.untrained().items()}
    x.shares = x.shares.astype(np.float64)

    def loss(params):
        rows, out, _ = extract.scores(params, x, np.arange(4))
        told = y[rows] >= 0
        return -np.mean(np.log(np.where(y[rows] == 1, out, 1 - out))[told])

    _, _, g = extract.scores(p, x, np.arange(4), y)
    draw = np.random.default_rng(0)
    for name in p:
        for _ in range(4):
            full = np.argwhere(np.abs(g[name]) > 1e-6)
            at = tuple(full[draw.integers(len(full))])
            up, down = ({**p, name: p[name].copy()} for _ in range(2))
            up[name][at] += 1e-4
            down[name][at] -= 1e-4
            assert abs((loss(up) - loss(down)) / 2e-4 - g[name][at]) < 2e-4 + 0.02 * abs(g[name][at]), name


def test_query_extracts_the_articles_of_the_table(spark):
    rows = {r["page_id"]: r for r in extract.op11_main_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(rows) == len(pages)
    right = sum(rows[p["page_id"]]["text"] == article_text(p["html"]) for p in pages)
    assert right >= 0.99 * len(pages)
    assert all(r["n_chars"] == len(r["text"]) for r in rows.values())


def test_other_templates(model):
    rng = random.Random(9)
    article = ["The heading of it", "First paragraph, with some words in it.", "Then a second one follows.", "Short.", "And the last paragraph ends here."]
    good = total = 0
    for _ in range(150):
        page, labels = extract.laid_out(article, ["Some other words here", "More of them. And more.", "Buy this now"], rng)
        blocks = extract.leaf_blocks(page)
        x = extract.inputs([blocks])
        score = extract.scores(model, x, np.array([0]))[1]
        good, total = good + int(((score >= 0.5) == np.array(labels)).sum()), total + len(labels)
    assert good / total > 0.95
    page = """<html><body><header><a href="/">Site</a></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
      <div class="cookie-banner"><p>We use cookies to improve this site.</p><button>Accept all</button></div>
      <main><article><h1>A title</h1><p>First paragraph of it, long enough to matter.</p><div class="ad">Buy now, a special offer!</div>
      <p>Second paragraph &mdash; the end.</p></article></main><aside class="sidebar"><h3>Related</h3><a href="/c">Another story</a></aside>
      <section class="comments"><h3>Comments</h3><p>I do not agree with this at all, says a reader.</p></section>
      <form><label>Your email</label><button>Subscribe</button></form><footer>&copy; 2024 Site. All rights reserved.</footer></body></html>"""
    assert kept(model, page) == ["A title", "First paragraph of it, long enough to matter.", "Second paragraph — the end."]


def test_odd_pages(spark, model):
    rows = [(1, "u", None, 1.0), (1, "u", "", 2.0), (None, None, "<article><p>a b c d.</p></article>", 3.0), (4, "v", "x" * 200_000, 4.0), (5, "w", "<p>" * 3000 + "</p><li>y" * 3000, 5.0)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, score double")
    got = extract.page_blocks(pages, model).collect()
    assert len(got) == 5 and [len(r["blocks"]) for r in sorted(got, key=lambda r: len(r["blocks"]))] == [0, 0, 1, 1, 3000]
    assert extract.page_blocks(pages.limit(0), model).count() == 0
    assert extract.learned([])["out"].shape == (2 * extract.HIDDEN + extract.WIDTH,)
