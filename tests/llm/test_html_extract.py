import html
import itertools
import random
import re

import numpy as np
import pytest

from quillspark.llm.html_blocks import Block, leaf_blocks
from quillspark.llm.html_extract import Extraction, Field, extract, likelihood, main_text, train
from quillspark.llm.labelled_pages import labelled_pages, sentence, words

SCHEMA = "page_id long, url string, html string, text string, n_chars string, label string"


@pytest.fixture(scope="module")
def field():
    return train(Extraction())


def texts(page):
    return [b.text for b in leaf_blocks(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a<b>b</b>c<br>d</p>e", ["abc d", "e"]),
        ("<p>one<p>two<li>three<li>four", ["one", "two", "three", "four"]),
        ("<p><b>a.<br><p>b", ["a.", "b"]),
        ('<script>var t="</p><p>no";</script>a<style>p{}</style><!-- no --><textarea><p>no</textarea>b<!-->c', ["abc"]),
        ('<p title="a>b" class=x data-a=\'<p>\'>a</p>', ["a"]),
        ("a &lt;b&gt; &amp;amp; &#x41;&eacute;&nbsp;c &am &copy; 1 < 2 <3", ["a <b> &amp; Aé c &am © 1 < 2 <3"]),
        ("<title>no</title><body>a<select><option>x<option>y</select>", ["a", "x", "y"]),
        ("<head><title>no</title><meta a=b><p>yes", ["yes"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ("<div>a</span></p></article>b</div>", ["a", "b"]),
        ("a<b", ["a"]),
        ("<svg><text>no</text></svg>a<br/>b<hr>c<SCRIPT>no</Script >d", ["a b", "cd"]),
        ("", []),
        ("</p></div> \n\t", []),
    ],
)
def test_leaf_blocks(page, want):
    assert texts(page) == want


def test_blocks_know_what_is_above():
    a, b = leaf_blocks('<div class="Side-barLeft x" id=y><p role="note">a</p></div><article><a href=x>b c</a></article>')
    assert set(a.above) == {"in:div", "named:side", "named:bar", "named:left", "named:x", "named:y", "in:p", "role:note"} and a.tag == "p" and a.linked == 0
    assert "in:article" in b.above and "in:div" not in b.above and b.linked == 1


def test_viterbi_is_the_best_of_all_labellings():
    draw = np.random.default_rng(2)
    for n in (1, 2, 5, 8):
        f = Field({"tag:p": 0.3}, draw.normal(size=(2, 2)))
        blocks = [Block("x", "p", (), (), 0.0, None) for _ in range(n)]
        scores = draw.normal(size=n)
        f.scores = lambda _, s=scores: s

        def value(labels, s=scores, f=f):
            return sum(x if y else -x for x, y in zip(s, labels)) + sum(f.steps[int(a), int(b)] for a, b in itertools.pairwise(labels))

        assert value(f.main(blocks)) == pytest.approx(max(map(value, itertools.product([False, True], repeat=n))))


def test_gradient_is_that_of_the_likelihood():
    draw = np.random.default_rng(3)
    there = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]], bool)
    cell = np.flatnonzero(there)
    block = np.repeat(np.arange(len(cell)), 2)
    x = (draw.integers(0, 3, len(block)), block, cell, draw.integers(0, 2, there.shape) * there, there)
    theta = draw.normal(size=7)
    value, gradient = likelihood(x, theta, 3)
    for k in range(7):
        more = theta.copy()
        more[k] += 1e-6
        assert (likelihood(x, more, 3)[0] - value) / 1e-6 == pytest.approx(gradient[k], abs=1e-4)
    # the labellings' likelihoods of one page add up to 1
    page = (np.array([0, 1]), np.array([0, 1]), np.array([0, 1]), None, np.ones((1, 2), bool))
    assert sum(np.exp(likelihood((*page[:3], np.array([y]), page[4]), theta, 3)[0]) for y in itertools.product([0, 1], repeat=2)) == pytest.approx(1)


def test_held_out_accuracy(field):
    wrong = total = 0
    for page in labelled_pages(300, 12345):
        blocks = leaf_blocks(page)
        total += len(blocks)
        wrong += sum((b.label == "main") != m for b, m in zip(blocks, field.main(blocks), strict=True))
    assert wrong / total < 0.01


PAGES = [
    (
        '<html><body><div id="top-nav"><a href=a>Home</a> <a href=b>News</a></div><div class="cookie-banner"><p>We use cookies to improve the site, as you know.</p><button>OK</button></div>'
        '<main><article class="post"><h1>Rain in May</h1><p>It rained, and it rained again.</p><div class="advertisement"><p>Buy our umbrellas today, they are the best.</p></div>'
        '<p>The river rose by two metres. See <a href=x>the map</a> of it.</p><ul><li>One bridge closed.</li><li>No one was hurt.</li></ul></article></main>'
        '<section id="comments"><h3>2 comments</h3><p>I saw it too, and it was terrible indeed.</p></section><footer>&copy; 2020 News &middot; Imprint</footer></body></html>',
        "Rain in May It rained, and it rained again. The river rose by two metres. See the map of it. One bridge closed. No one was hurt.",
    ),
    (
        "<body><header><h1><a href=/>Site</a></h1></header><nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></nav><article><h1>Title</h1><p>Short.</p><p>Menu | like | words | here</p></article>"
        "<aside><h3>Related</h3><p>Another long story that is not of this page, with commas.</p></aside><form><label>Mail</label><input></form></body>",
        "Title Short. Menu | like | words | here",
    ),
    ("<nav><a href=a>A</a></nav><div class=ad>Buy now.</div><footer>&copy; x</footer>", ""),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_pages_by_hand(field, page, want):
    assert main_text(page, field) == want


def test_articles_exactly(field):
    """Articles of any words, junk included, between a menu, an advert and a footer."""
    draw = random.Random(8)
    junk = lambda: " | ".join(words(draw, 1) for _ in range(draw.randint(2, 12)))
    noisy = lambda: " ".join(w + draw.choice(["%%%", "$$$", "&amp;&amp;", "###", ""]) for w in words(draw, 9).split())
    for _ in range(300):
        paragraphs = [draw.choice([sentence, lambda _: junk(), lambda _: noisy(), lambda d: words(d, 1) + ".", lambda d: str(d.randint(1, 9**9))])(draw) for _ in range(draw.choice([1, 1, 2, 6, 40]))]
        body = "".join(draw.choice(["<p>{}</p>", "<p><b>{}<br>", "<p>{}\n</p>"]).format(p) for p in paragraphs)
        page = f'<!DOCTYPE html><html><head><title>{words(draw, 3)}</title><script>var t="</p>";</script></head><body><nav><ul>' + "".join(f'<li><a href="/{i}">{words(draw, 1)}</a></li>' for i in range(6))
        page += f'</ul></nav><!-- ad --><div class="ad">{sentence(draw)} {sentence(draw)}</div><article><h1>{words(draw, 5)}</h1>{body}</article><footer>&copy; {words(draw, 1)} &middot; {sentence(draw)}</footer></body></html>'
        inside = re.search("<article>(.*)</article>", page, re.S)[1]
        assert main_text(page, field) == " ".join(html.unescape(re.sub("<[^>]*>", " ", inside.replace("<b>", ""))).split())


def test_odd_rows(spark, field):
    long = "<article>" + "<p>A long sentence of the page, again.</p>" * 30_000 + "</article>"
    deep = "<div>" * 20_000 + "<p>Deep in the page, but there.</p>"
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<article><p>A.</p></article>"), (3, "u", " \x00 "), (4, "u", long), (5, "u", deep), (5, "u", deep), (6, "u", "<p " * 50_000)]
    out = extract(spark.createDataFrame([(*r, *["x"] * 3) for r in rows], SCHEMA))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted(((i, u, (t := main_text(h, field)), len(t)) for i, u, h in rows), key=str)
    assert [t for i, _, t, _ in got if i == 4] == [" ".join(["A long sentence of the page, again."] * 30_000)]
    assert extract(spark.createDataFrame([], SCHEMA)).collect() == []
