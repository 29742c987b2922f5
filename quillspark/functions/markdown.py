"""Markdown and HTML rewrites as Column -> Column functions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import JS_SPACE, PY_SPACE, let, literal_all, matches_of, replace_all, rewrite_matches, strip


def postprocess(text: Column, keep_footnotes: bool = True) -> Column:
    """Normalised Markdown: headings and images on their own, no runs of blank lines, one end.

    The order of the rules is part of the result: blank lines around ``$$`` go last, and the
    rule for lines after a heading isn't anchored at the line's start.
    """
    text = literal_all(text, ("\r\n", "\n"), ("\r", "\n"))
    # The patterns of the rules, in their order.
    text = replace_all(
        text,
        (r"[ \t]+(?=\n|\z)", ""),
        (rf"(?md)^(#{{1,6}})([^#{PY_SPACE}])", "$1 $2"),
        (r"([^\n])\n(#{1,6} )", "$1\n\n$2"),
        (r"(#{1,6} [^\n]+)\n([^\n#])", "$1\n\n$2"),
        (r"([^\n])\n(!\[[^\]]*\]\([^)]+\))", "$1\n\n$2"),
        (r"(!\[[^\]]*\]\([^)]+\))\n([^\n])", "$1\n\n$2"),
        (r"\n{3,}", "\n\n"),
    )
    text = literal_all(text, ("\\$", "$"))
    # the second pattern is tried at every character, which texts without display formulas are spared
    apart = lambda t: replace_all(t, (rf"\$\$[{PY_SPACE}]*\n[{PY_SPACE}]*", r"\$\$" + "\n"), (rf"[{PY_SPACE}]*\n[{PY_SPACE}]*\$\$", "\n" + r"\$\$"))
    text = let(text, lambda t: F.when(t.contains("$$"), apart(t)).otherwise(t))
    if not keep_footnotes:
        text = replace_all(text, (r"\[\^[^\]]+\]", ""), (r"(?md)^\[\^[^\]]+\]:[^\n]*$", ""))
    return F.concat(strip(text), F.lit("\n"))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


TABLE = r"(?is)<table[^>]*>.*?</table>"


def table_to_pipe(table: Column) -> Column:
    """One HTML table as pipe rows; the separator follows the first row if that has cells."""
    rows = matches_of(table, r"(?is)<tr[^>]*>(.*?)</tr>", 1)

    def row(html: Column, i: Column) -> Column:
        cells = F.transform(matches_of(html, r"(?is)<t[hd][^>]*>(.*?)</t[hd]>", 1), lambda c: strip(F.replace(strip_tags(c), F.lit("\n"), F.lit(" "))))
        line = F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
        rule = F.concat(F.lit("\n| "), F.array_join(F.transform(cells, lambda _: F.lit("---")), " | "), F.lit(" |"))
        return F.when(F.size(cells) > 0, F.concat(line, F.when(i == 0, rule).otherwise(F.lit(""))))

    lines = F.filter(F.transform(rows, row), lambda x: x.isNotNull())
    return F.concat(F.lit("\n\n"), F.array_join(lines, "\n"), F.lit("\n\n"))


def tables_to_pipe(html: Column) -> Column:
    """All tables in their places; texts without one pass through untouched."""
    return let(html, lambda t: F.when(F.lower(t).contains("<table"), rewrite_matches(t, TABLE, table_to_pipe)).otherwise(t))


def _headings(text: Column, level: int) -> Column:
    whole = rf"(?is)<h{level}[^>]*>.*?</h{level}>"

    def heading(match: Column) -> Column:
        inner = F.regexp_extract(match, rf"(?is)<h{level}[^>]*>(.*?)</h{level}>", 1)
        return F.concat(F.lit("\n\n" + "#" * level + " "), strip(strip_tags(inner)), F.lit("\n\n"))

    return let(text, lambda t: F.when(F.lower(t).contains(f"<h{level}"), rewrite_matches(t, whole, heading)).otherwise(t))


def html_to_markdown(html: Column) -> Column:
    """Ordered tag rewrites; prefix-loose as intended (``<b`` also takes ``<body``)."""
    text = html
    for level in range(6, 0, -1):
        text = _headings(text, level)
    # The patterns of the rules, in their order.
    text = replace_all(
        text,
        (rf"(?i)<br[{PY_SPACE}]*/?>", "\n"),
        (rf"(?i)</p>[{PY_SPACE}]*<p[^>]*>", "\n\n"),
        (r"(?i)<p[^>]*>", "\n\n"),
        (r"(?i)</p>", "\n\n"),
        (r"(?is)<strong[^>]*>(.*?)</strong>", "**$1**"),
        (r"(?is)<b[^>]*>(.*?)</b>", "**$1**"),
        (r"(?is)<em[^>]*>(.*?)</em>", "*$1*"),
        (r"(?is)<i[^>]*>(.*?)</i>", "*$1*"),
        (r'(?i)<img[^>]*src="([^"]+)"[^>]*alt="([^"]*)"[^>]*/?>', "![$2]($1)"),
        (r'(?i)<img[^>]*alt="([^"]*)"[^>]*src="([^"]+)"[^>]*/?>', "![$1]($2)"),
        (r'(?i)<img[^>]*src="([^"]+)"[^>]*/?>', "![]($1)"),
        (r"(?i)<li[^>]*>", "\n- "),
        (r"(?i)</li>", ""),
        (r"(?i)</?ul[^>]*>", "\n"),
        (r"(?i)</?ol[^>]*>", "\n"),
    )
    text = replace_all(
        tables_to_pipe(text),
        (r'(?is)<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>', "[$2]($1)"),
        (rf"(?i)<hr[{PY_SPACE}]*/?>", "\n\n---\n\n"),
    )
    return literal_all(strip_tags(text), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'))


def plain_text(html: Column) -> Column:
    """Tags out, pictures and formulas as marks, four entities, white space collapsed."""
    # The marks and entities.
    text = replace_all(html, (r"(?i)<img[^>]*>", "[图]"), (r'(?i)<span[^>]*class="katex[\s\S]*?</span>', "[公式]"), ("<[^>]+>", ""))
    text = literal_all(text, ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
    return strip(F.regexp_replace(text, rf"[{JS_SPACE}]+", " "), JS_SPACE)


def escape_html(text: Column, quotes: bool = True) -> Column:
    return literal_all(text, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;")] if quotes else []))


def image_tag(src: Column, alt: Column) -> Column:
    named = F.when(F.coalesce(alt, F.lit("")) == "", F.lit("题目配图")).otherwise(alt)
    return F.concat(F.lit('<img src="'), escape_html(src), F.lit('" alt="'), escape_html(named), F.lit('" loading="lazy" />'))


def image_target(raw: Column) -> Column:
    """The path of ``![..](..)``: without title, angle brackets or quotes."""
    text = strip(raw, JS_SPACE)
    s = JS_SPACE
    text = F.regexp_replace(text, rf"""\A([^\n]*?)[{s}]+(?:"[^"]*"|'[^']*')[{s}]*\z""", "$1")
    text = strip(text, s)
    text = let(text, lambda t: F.when(t.rlike(r"(?s)\A<.*>\z"), strip(F.regexp_replace(t, r"(?s)\A<(.*)>\z", "$1"), s)).otherwise(t))
    quoted = lambda t: t.rlike(r"""(?s)\A".*"\z|\A'.*'\z""") & (F.length(t) >= 2)
    return let(text, lambda t: F.when(quoted(t), strip(F.regexp_replace(t, r"(?s)\A.(.*).\z", "$1"), s)).otherwise(t))


def path_key(path: Column) -> Column:
    """Trimmed, slashes forward, one leading ``./`` or ``/`` off, then ``file://``, lower case."""
    return F.lower(replace_all(F.replace(strip(path, JS_SPACE), F.lit("\\"), F.lit("/")), (r"\A\.?/", ""), (r"(?i)\Afile://", "")))


def base_key(path: Column) -> Column:
    last = lambda norm: F.element_at(F.split(norm, "/", -1), -1)
    return let(path_key(path), lambda norm: F.when(last(norm) == "", norm).otherwise(last(norm)))


def expand_tabs(text: Column) -> Column:
    return F.replace(text, F.lit("\t"), F.lit("    "))


def job_id(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, r"[^A-Za-z0-9_\-]", ""), 1, 40)


#: Content types and the extensions their pictures get.
EXTENSIONS = {
    "image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/bmp": ".bmp", "image/x-emf": ".emf",
    "image/emf": ".emf", "image/x-wmf": ".wmf", "image/wmf": ".wmf", "application/x-emf": ".emf", "application/x-msmetafile": ".wmf",
}


def extension_of(mime: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, mime), F.lit(".png"))


def with_bom(text: Column) -> Column:
    return F.when(text.startswith("\ufeff"), text).otherwise(F.concat(F.lit("\ufeff"), text))


def preview(text: Column, limit: int = 4000) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n…(truncated)"))).otherwise(text)


def render_pipe_table(block: Column) -> Column:
    """A pipe table as HTML; rows are padded or cut to the header's width, other text is escaped."""
    clean = F.filter(F.transform(F.split(strip(block, JS_SPACE), "\n", -1), lambda x: strip(x, JS_SPACE)), lambda x: x != "")
    cells = lambda line: F.transform(F.split(replace_all(line, (r"\A\|", ""), (r"\|\z", "")), r"\|", -1), lambda c: strip(c, JS_SPACE))
    tagged = lambda xs, tag: F.array_join(F.transform(xs, lambda c: F.concat(F.lit(f"<{tag}>"), escape_html(c), F.lit(f"</{tag}>"))), "")

    def table(lines: Column, header: Column) -> Column:
        fit = lambda line: F.slice(F.concat(cells(line), F.array_repeat(F.lit(""), F.size(header))), F.lit(1), F.size(header))
        body = F.transform(F.slice(lines, F.lit(3), F.size(lines)), lambda line: F.concat(F.lit("<tr>"), tagged(fit(line), "td"), F.lit("</tr>")))
        return F.concat(F.lit('<div class="md-table-wrap"><table><thead><tr>'), tagged(header, "th"), F.lit("</tr></thead><tbody>"), F.array_join(body, ""), F.lit("</tbody></table></div>"))

    def whole(lines: Column) -> Column:
        rule = F.get(lines, F.lit(1))
        ruled = rule.rlike(rf"\A\|?[{JS_SPACE}:|-]+\|?\z") & rule.contains("-")
        made = let(cells(F.get(lines, F.lit(0))), lambda header: table(lines, header))
        return F.when(F.size(lines) < 2, escape_html(block)).when(~ruled, F.replace(escape_html(block), F.lit("\n"), F.lit("<br/>"))).otherwise(made)

    return let(clean, whole)
