"""A Markdown fragment of a question as HTML.  Formulas become marked spans of normalised TeX, as
no formula renderer runs here; everything else follows the page's own markup."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import latex_repair as R

# HTML that may stay, the mark of a missing picture.
BLOCK = re.compile(r"<(table|thead|tbody|tr|td|th|div|p|ul|ol|li|br|hr|span|sup|sub|section)\b[^>]*>[\s\S]*?</\1>", re.I)
MISSING = '<span class="md-image-missing" title="原 PDF 中的配图未嵌入">[配图]</span>'
ROUNDS = 32


def escape(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def formula(tex: str, display: bool) -> str:
    body = escape(R.normalize_tex(tex))
    return f'<span class="katex{" display" if display else ""}">{body}</span>' if body else ""


def image(src: str, alt: str) -> str:
    return f'<img src="{escape(src)}" alt="{escape(alt or "题目配图")}" loading="lazy" />'


def target(raw: str) -> str:
    t = raw.strip()
    titled = re.match(r"""(.*?)\s+("[^"]*"|'[^']*')\s*\Z""", t)
    t = titled[1].strip() if titled else t
    for a, b in (("<", ">"), ('"', '"'), ("'", "'")):
        if len(t) > 1 and t.startswith(a) and t.endswith(b):
            t = t[1:-1].strip()
    return t


def pipe_table(block: str) -> str:
    lines = [x for x in (y.strip() for y in block.strip().split("\n")) if x]
    if len(lines) < 2:
        return escape(block)
    cells = lambda x: [c.strip() for c in re.sub(r"^\||\|$", "", x).split("|")]
    if not re.fullmatch(r"\|?[\s:|-]+\|?", lines[1]) or "-" not in lines[1]:
        return escape(block).replace("\n", "<br/>")
    head = cells(lines[0])
    row = lambda xs, tag: "".join(f"<{tag}>{escape(x)}</{tag}>" for x in xs)
    body = "".join(f"<tr>{row((cells(x) + [''] * len(head))[: len(head)], 'td')}</tr>" for x in lines[2:])
    return f'<div class="md-table-wrap"><table><thead><tr>{row(head, "th")}</tr></thead><tbody>{body}</tbody></table></div>'


def to_html(md: str) -> str:
    """Ordered stages; each parks what it has made, so that no later stage reads it as Markdown.

    Fixed values: the patterns of the stages, in their order.
    """
    s = md.strip()
    if not s:
        return ""
    slots = R.Slots("MD")
    park = slots.park
    s = R.prepare(s.replace("\r\n", "\n").replace("＄", "$"))
    s = R.split_adjacent(R.recover_dollars(R.word_artifacts(s)))
    s = re.sub(r"(?i)<!--\s*image\s*-->", lambda _: park(MISSING), s)
    for pattern, display in ((r"\$\$([\s\S]+?)\$\$", True), (r"\\\[([\s\S]+?)\\\]", True), (r"\\\(([\s\S]+?)\\\)", False)):
        s = re.sub(pattern, lambda m, display=display: park(formula(m[1], display)), s)
    s = R.replace_inline(s, lambda tex: park(formula(tex, False)))
    s = re.sub(r"(?m)(^|[\s（）])\$(?=[\s）]|$)", r"\1", s).replace("\\_", "_")
    s = re.sub(r"!\[\[([^\]]+)\]\]", lambda m: park(image(m[1].split("|")[0].strip(), "题目配图")), s)
    s = re.sub(r"!\[([^\]]*)\]\(([^)]+)\)", lambda m: park(image(target(m[2]), m[1])), s)
    s = BLOCK.sub(lambda m: park(m[0]), s)
    s = re.sub(r"(?i)<img\b[^>]*>", lambda m: park(m[0]), s)
    s = re.sub(r"(?i)<br\s*/?>", lambda _: park("<br/>"), s)
    s = re.sub(r"(\A|\n)((?:\|[^\n]*\|\n)+)", lambda m: m[1] + park(pipe_table(m[2])), s)
    s = re.sub(r"(?m)^(#{1,4})\s+([^\n]+)$", lambda m: park(f'<h{len(m[1]) + 2} class="md-h">{escape(m[2])}</h{len(m[1]) + 2}>'), s)
    for pattern, tag in ((r"`([^`]+)`", "code"), (r"\*\*([^*]+)\*\*", "strong"), (r"\*([^*]+)\*", "em")):
        s = re.sub(pattern, lambda m, tag=tag: park(f"<{tag}>{escape(m[1])}</{tag}>"), s)
    s = re.sub(r"(?<!\n)([ \t]+)([A-Da-d][.．、])", r"\n\2", s)
    return slots.back(escape(s).replace("\n", "<br/>"), ROUNDS)


def _column(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else to_html(x))


fragment_html = F.pandas_udf(_column, StringType())
