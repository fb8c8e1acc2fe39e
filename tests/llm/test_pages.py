"""Main text of pages: labelled pages held out, pages of many shapes, and the parser's rules."""

import html
import re

import duckdb
import numpy as np
import pytest

from tapeloom.llm import htmlcrf
from tapeloom.llm.htmlcrf import features, labelled_pages, leaf_blocks, trained

COLUMNS = "page_id long, url string, html string, text string, n_chars string, labels int"
PROSE = "This is a sentence, long enough to read as prose. And here follows another one, with some more words in it."


def extracted(spark, pages):
    rows = [(k, f"http://x/{k}", p, "clash", "clash", 1) for k, p in enumerate(pages)]
    return {r.page_id: r for r in htmlcrf.extract(spark.createDataFrame(rows, COLUMNS)).collect()}


def test_held_out_labels():
    pages = list(labelled_pages(200, seed=77))
    found = trained().decode([features(b) for b, _ in pages])
    right = [a == b for (_, gold), own in zip(pages, found, strict=True) for a, b in zip(gold, own, strict=True)]
    assert np.mean(right) > 0.98


def test_viterbi_finds_the_best_path():
    model, draw = trained(), np.random.default_rng(3)
    for blocks, _ in labelled_pages(30, seed=5):
        page = features(blocks[:9])
        own = model.decode([page])[0]
        local = [sum(model.weight[model.number[f]] for f in b if f in model.number) for b in page]
        score = lambda ls: sum(x for x, k in zip(local, ls, strict=True) if k) + sum(model.step[a, b] for a, b in zip(ls, ls[1:], strict=False))
        best = max(score([n >> k & 1 for k in range(len(page))]) for n in range(1 << len(page)))
        assert abs(score(own) - best) < 1e-9
    assert draw is not None and model.decode([[], []]) == [[], []]


def test_training_follows_the_gradient():
    """At the end of a long training the expected counts meet the seen ones, up to the penalty."""
    pages = [(features(b), labels) for b, labels in labelled_pages(30, seed=1)]
    short, long = htmlcrf.train(pages, steps=20), htmlcrf.train(pages, steps=200)

    def loss(model):
        total = 0.0
        for blocks, labels in pages:
            local = [sum(model.weight[model.number[f]] for f in b) for b in blocks]
            ahead = np.array([0, local[0]])
            for x in local[1:]:
                ahead = np.logaddexp(ahead[0] + model.step[0], ahead[1] + model.step[1]) + np.array([0, x])
            gold = sum(x for x, k in zip(local, labels, strict=True) if k) + sum(model.step[a, b] for a, b in zip(labels, labels[1:], strict=False))
            total += np.logaddexp(*ahead) - gold
        return total / len(pages)

    assert loss(long) < loss(short) < loss(htmlcrf.Field(short.number, np.zeros(len(short.number))))


def test_leaf_blocks():
    page = """<!DOCTYPE html><title>no</title><body><div class="side-bar mainMenu" id=x1>a &amp; b &copy; <b>c</b>d<br>e<script>var t = "</p><p>";</script>
      <p>one<p>two &#x41;&nbsp; three</div><ul><li>x<li><a href="a>b">y</a></ul><!-- <p>no</p> -->tail < 3<style>p{}</style>"""
    got = leaf_blocks(page)
    assert [b.text for b in got] == ["a & b © cd e", "one", "two A three", "x", "y", "tail < 3"]
    assert got[0].path[-1] == "div side bar main menu x" and got[2].path[-1] == "p" and got[4].linked == 1
    assert got[3].path[-2:] == ("ul", "li") and got[4].path[-2:] == ("ul", "li")


def test_pages_of_many_shapes(spark):
    menu = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>About</a></li></ul></nav>"
    foot = "<footer>&copy; someone &middot; all rights</footer>"
    comments = f"<div class='comments'><h3>Comments</h3><div class='comment'><p>{PROSE}</p></div><div class='comment'><p>Nice one!</p></div></div>"
    pages = [
        None, "", "   ", "<html><body></body></html>", menu + foot,
        f"{menu}<article><h1>A title</h1><p>{PROSE}</p><p>{PROSE} &lt;tag&gt;</p></article>{foot}",
        f"<header><h1>Site</h1></header>{menu}<div class='content'><p>{PROSE}</p><p>{PROSE}</p></div>{comments}{foot}",
        f"<div class='cookie-notice'><p>We use cookies.</p><button>OK</button></div><main><p>{PROSE}</p></main><aside class='sidebar'><p>Related</p></aside>",
        f"{menu}<article><p>{PROSE}</p><div class='ad'>Buy this, now.</div><p>{PROSE}</p></article><form><label>Name</label></form>{foot}",
        f"<article><p>{'word ' * 20000}</p></article>", "<p" * 3000, "<" * 5000, f"<article><p>unclosed {PROSE}",
    ]
    got = extracted(spark, pages)
    assert [got[k].text for k in range(5)] == [""] * 5 and all(r.n_chars == len(r.text) for r in got.values())
    assert got[5].text == f"A title {PROSE} {PROSE} <tag>"
    assert got[6].text == got[8].text == f"{PROSE} {PROSE}" and got[7].text == PROSE
    assert got[9].n_chars == 20000 * 5 - 1 and got[12].text == f"unclosed {PROSE}"
    assert {r.url for r in got.values()} == {f"http://x/{k}" for k in range(len(pages))}


def test_given_pages(spark):
    """In the supplied pages the article element holds the main text."""
    path = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select page_id, html from '{path}/pages.parquet'").fetchall()
    got = {r.page_id: r.text for r in htmlcrf.extract(spark.read.parquet(f"{path}/pages.parquet")).collect()}
    right = 0
    for page_id, page in rows:
        inner = page[page.index("<article>") + 9 : page.index("</article>")]
        want = re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", inner))
        right += got[page_id] == " ".join(html.unescape(want).split())
    assert right >= 0.99 * len(rows)


@pytest.mark.parametrize("rows", [0])
def test_empty_table(spark, rows):
    assert htmlcrf.extract(spark.createDataFrame([], COLUMNS)).count() == rows
