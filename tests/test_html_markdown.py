"""Structures of HTML as Markdown: nesting, white space, escapes, code, formulas and damage."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.operators.html_markdown import to_markdown
from quillspark.plans.picture_queries import STRUCTURES


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<ul>\n  <li>a</li>\n  <li>b\n    <ol>\n <li>c</li>\n</ol>\n tail</li>\n</ul>", "-   a\n-   b\n    \n    1.  c\n    \n    tail"),
        ("<ol start='x'><li>a</li></ol><ol start='-2'><li>a</li><li>b</li></ol>", "1.  a\n\n-2.  a\n-1.  b"),
        ("<ol>" + "<li>x</li>" * 11 + "</ol>", "\n".join(f"{k}.  x" for k in range(1, 12))),
        ("<blockquote><ul><li>a</li><li>b</li></ul></blockquote>", "> -   a\n> -   b"),
        ("<pre><code>```\na\n</code></pre>", "````\n```\na\n````"),
        ("<pre>a_b  c\n d</pre>", "a\\_b  c\n d"),
        ("<code> a </code>|<code>`</code>|<code></code>|<code>a\nb</code>", "`a` |`` ` ``||`a b`"),
        ("<p>a <em> b </em> c</p><p><b> </b>x<strong><i>y</i></strong></p>", "a *b* c\n\nx***y***"),
        ("<p>a</p>b<p>c</p><br>d", "a\n\nb\n\nc\n\n  \nd"),
        ("<a>no</a> <a href='x'></a> <a href=\"a b\" title='q\"'>t</a>", "no [](x)[t](a b \"q\\\"\")"),
        ("* - \\ `x` [a] #", "\\* - \\\\ \\`x\\` \\[a\\] #"),
        ("<p>- a</p><p>#a</p><p>## a</p><p>12. a</p><p>~~~ a</p>", "\\- a\n\n#a\n\n\\## a\n\n12\\. a\n\n\\~~~ a"),
        ("<p>cost $5</p><p>and $6</p>", "cost $5</p><p>and $6"),
        ("<p>$a\nb$</p>", "$a b$"),
        ("@@LATEX3@@ $x$", " $x$"),
        ("</p></ul>a</b><td>b</td>", "a\n\nb"),
        ("<p>a<table><tr><td>b<td>c<tr><td>d</table>", "a\n\nb\n\nc\n\nd"),
        ("<img alt='a' src=''><img><img src='s'>", "![配图](s)"),
        ("a &lt; b &amp;lt; <", "a < b &lt; <"),
        ("<style>p{}</style><!-- x --><title>t</title>a", "a"),
    ],
)
def test_structures(page, want):
    assert to_markdown(page) == want


def test_nothing():
    assert to_markdown(None) is None and to_markdown("") == "" and to_markdown("<p></p><div> \n</div>") == ""


def test_registered_structures_have_no_loose_marks():
    for page, _ in STRUCTURES:
        assert "@@LATEX" not in to_markdown(page)


@given(st.lists(st.sampled_from(["<p>", "</p>", "<ul>", "<ol>", "<li>", "</li>", "</ul>", "</ol>", "<b>", "</b>", "<pre>", "<code>", "</code>", "</pre>", "<blockquote>", "</blockquote>", "<td>", "x", " y ", "\n", "$z$", "<br>", "<hr>", "<a href=u>", "</a>", "1. q"]), max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_order_of_tags_keeps_the_text(parts):
    out = to_markdown("".join(parts))
    for word in ("x", "y", "$z$", "q"):
        assert out.count(word) == sum(p.strip() == word or (word == "q" and p == "1. q") for p in parts)
