"""Blocks and marks of Markdown as HTML, and any text in linear time without losing words."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.operators.markdown_html import to_html


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a\nb\n\nc", "<p>a<br />\nb</p>\n<p>c</p>"),
        ("a\n# b\nc", "<p>a</p>\n<h1>b</h1>\n<p>c</p>"),
        ("- a\n  - b\n  - c\n- d", "<ul>\n<li>a<ul>\n<li>b</li>\n<li>c</li>\n</ul>\n</li>\n<li>d</li>\n</ul>"),
        ("- a\n\n1. b", "<ul>\n<li>a</li>\n</ul>\n<ol>\n<li>b</li>\n</ol>"),
        ("a\n- b", "<p>a<br />\n- b</p>"),
        ("> a\n>\n> > b\n\nc", "<blockquote>\n<p>a</p>\n<blockquote>\n<p>b</p>\n</blockquote>\n</blockquote>\n<p>c</p>"),
        ("```\n# x\n- y\n```", "<pre><code># x\n- y\n</code></pre>"),
        ("```\nopen", "<p>```<br />\nopen</p>"),
        ("a | b\n--|--\n1 | 2 | 3\n4", "<table>\n<thead>\n<tr>\n<th>a</th>\n<th>b</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>1</td>\n<td>2</td>\n</tr>\n</tbody>\n</table>\n<p>4</p>"),
        ("**a *b* c** *d*e* __f__ 2 * 3 * 4", "<p><strong>a <em>b</em> c</strong> <em>d</em>e* <strong>f</strong> 2 * 3 * 4</p>"),
        ("`` a`b `` `*x*` \\`y", "<p><code>a`b</code> <code>*x*</code> `y</p>"),
        ("[a *b*](u(1) \"t\") ![x *y*](<a b>) [no] (u)", '<p><a href="u(1)" title="t">a <em>b</em></a> <img alt="x *y*" src="a b" /> [no] (u)</p>'),
        ("&copy; &x &#1; <!-- *c* -->", "<p>&copy; &amp;x &#1; <!-- *c* --></p>"),
        ("---\n***\n- - -", "<hr />\n<hr />\n<hr />"),
    ],
)
def test_blocks_and_marks(text, want):
    assert to_html(text) == want


@given(st.lists(st.sampled_from(["a", "- b", "1. c", "    d", "> e", "```", "| f | g |", "|--|--|", "", "# h", "**i", "`j", "[k](l", "<m>", "***", "\\*"]), max_size=25))
@settings(max_examples=300, deadline=None)
def test_any_lines_keep_their_words(lines):
    out = to_html("\n".join(lines))
    for word in "abcdeh":
        assert len(re.findall(rf"(?<![a-z]){word}(?![a-z])", re.sub("<[^>]*>", " ", out))) == sum(bool(re.fullmatch(rf"\W*(?:1\. )?{word}", x)) for x in lines)


def test_long_and_deep_texts():
    for text in ("- x\n" * 20_000, "> " * 400 + "x", "*a" * 20_000, "[" * 5_000 + "a", "`" * 3_000 + " a", "x\n" * 20_000, "a | b\n--|--\n" + "1 | 2\n" * 20_000):
        began = time.time()
        assert "x" in to_html(text) or "a" in to_html(text)
        assert time.time() - began < 20
    assert to_html(None) is None and to_html("") == ""
