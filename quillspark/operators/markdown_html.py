"""Markdown to preview HTML: a fold over lines with a stack of open blocks, then inline marks.

Blocks: headings, rules, quotes, fenced code, pipe tables, lists nested by indentation (a list's kind changes only with a blank line between), paragraphs
in which every line end is a break, and HTML blocks that stay as they are.  Inline: code, pictures, links, strong, emphasis, escapes,
automatic links.  Each line is looked at once per open block; what can't be read as a mark is text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

FENCE = re.compile(r"(`{3,}|~{3,})[ ]*([\w#.+-]*)[^`]*\Z")
ITEM = re.compile(r"([ ]{0,3})(?:([-*+])|([0-9]{1,9})[.])[ ]+(.*)\Z")
RULE = re.compile(r"[ ]{0,3}(?:\*[ ]*){3,}\Z|[ ]{0,3}(?:-[ ]*){3,}\Z|[ ]{0,3}(?:_[ ]*){3,}\Z")
DIVIDER = re.compile(r"[ ]{0,3}\|?[ ]*:?-+:?[ ]*(?:\|[ ]*:?-+:?[ ]*)*\|?[ ]*\Z")
#: Elements whose lines are no Markdown.
HTML_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|details|div|dl|fieldset|figure|footer|form|h[1-6]|header|hr|main|nav|ol|p|pre|section|script|style|table|ul)\b", re.I)
DEEPEST = 20

CODE = re.compile(r"(?<![`\\])(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
LINK = re.compile(r"""(!?)\[((?:[^\[\]\\]|\\.)*)\]\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\([^\s()]*\))*))(?:\s+(?:"([^"\n]*)"|'([^'\n]*)'))?\s*\)""")
TAG = re.compile(r"<(?:/?[a-zA-Z][^<>\n]*|!--.*?--)>", re.S)
AUTO = re.compile(r"<((?:https?|ftp)://[^\s<>]+)>")
ESCAPED = re.compile(r"\\([\\`*_{}\[\]()>#+.!|-])")
STRONG = re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", re.S)
EMPHASIS = re.compile(r"(?<![\w*])(\*)(?=[^\s*])(.+?)(?<=[^\s*])\1(?!\*)|(?<![\w_])(_)(?=[^\s_])(.+?)(?<=[^\s_])\3(?!\w)", re.S)
AND = re.compile(r"&(?!#?\w+;)")


@dataclass
class Parked:
    """Finished HTML as characters that stand in no text."""

    first: int
    held: list[str] = field(default_factory=list)

    def __call__(self, made: str) -> str:
        self.held.append(made)
        return chr(self.first + len(self.held) - 1) if self.first + len(self.held) - 1 <= 0x10FFFF else made

    def back(self, text: str) -> str:
        # the last first: what was parked later may hold what was parked before
        for k in range(len(self.held) - 1, -1, -1):
            if self.first + k <= 0x10FFFF and chr(self.first + k) in text:
                text = text.replace(chr(self.first + k), self.held[k])
        return text


def inline(text: str) -> str:
    """Marks within a block, line ends as breaks."""
    park = Parked(max(0xF0000, max(map(ord, text), default=0) + 1))
    text = CODE.sub(lambda m: park(f"<code>{escape(m[2].strip(), quote=False)}</code>"), text)
    text = ESCAPED.sub(lambda m: park(escape(m[1], quote=False)), text)

    def link(m: re.Match) -> str:
        target, title = m[3] if m[3] is not None else m[4], m[5] or m[6]
        named = f' title="{escape(title)}"' if title else ""
        target = escape(park.back(target).replace("&amp;", "&"))
        if m[1]:
            return park(f'<img alt="{escape(park.back(m[2]))}" src="{target}"{named} />')
        return park(f'<a href="{target}"{named}>') + m[2] + park("</a>")

    text = LINK.sub(link, text)
    text = AUTO.sub(lambda m: park(f'<a href="{escape(m[1])}">{escape(m[1])}</a>'), text)
    text = TAG.sub(lambda m: park(m[0]), text)
    text = AND.sub("&amp;", text).replace("<", "&lt;").replace(">", "&gt;")
    text = STRONG.sub(lambda m: f"<strong>{m[2]}</strong>", text)
    text = EMPHASIS.sub(lambda m: f"<em>{m[2] or m[4]}</em>", text)
    text = re.sub(r"[ ]*\n[ ]*", "<br />\n", text)
    return park.back(text)


def cells(line: str) -> list[str]:
    line = re.sub(r"(?<!\\)\|\s*\Z", "", line.strip().removeprefix("|"))
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]


def table(lines: list[str]) -> str:
    side = []
    for c in cells(lines[1]):
        side.append("center" if c[:1] == c[-1:] == ":" else "right" if c[-1:] == ":" else "left" if c[:1] == ":" else "")
    head = cells(lines[0])
    cell = lambda tag, text, k: f"<{tag}{f' style={chr(34)}text-align: {side[k]};{chr(34)}' if side[k] else ''}>{inline(text)}</{tag}>"
    row = lambda tag, texts: "<tr>\n" + "\n".join(cell(tag, (texts[k] if k < len(texts) else ""), k) for k in range(len(side))) + "\n</tr>\n"
    body = "".join(row("td", cells(x)) for x in lines[2:])
    return f"<table>\n<thead>\n{row('th', head)}</thead>\n<tbody>\n{body}</tbody>\n</table>"


def indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def lists(lines: list[str], at: int, depth: int) -> tuple[str, int]:
    """The list that begins at a line, and the line after it."""
    ordered, items, loose = ITEM.match(lines[at])[3] is not None, [], False
    start = int(ITEM.match(lines[at])[3] or 1)
    while at < len(lines):
        m = ITEM.match(lines[at])
        if not m or (m[3] is not None) != ordered or RULE.match(lines[at]):
            break
        own, at, blank = [m[4]], at + 1, False
        while at < len(lines):
            line = lines[at]
            if not line.strip():
                blank = True
            elif indent(line) >= 4 or (indent(line) >= 2 and not blank and ITEM.match(line[2:]) and indent(line) > len(m[1]) + 1):
                own += [""] * blank + [line[min(4, indent(line)) :]]
                loose, blank = loose or blank, False
            elif blank or ITEM.match(line) or RULE.match(line) or FENCE.match(line) or line.startswith("#"):
                break
            else:
                own.append(line.strip())
            at += 1
        items.append(own)
        if blank:
            loose = loose or (at < len(lines) and bool(ITEM.match(lines[at])) and (ITEM.match(lines[at])[3] is not None) == ordered)
    tag = "ol" if ordered else "ul"
    first = f' start="{start}"' if ordered and start != 1 else ""
    made = []
    for own in items:
        text = blocks(own, depth + 1, tight=not loose)
        made.append(f"<li>\n{text}</li>" if loose else f"<li>{text}</li>")
    return f"<{tag}{first}>\n" + "\n".join(made) + f"\n</{tag}>", at


def blocks(lines: list[str], depth: int = 0, tight: bool = False) -> str:
    out: list[str] = []
    held: list[str] = []

    def end() -> None:
        if held:
            text = inline("\n".join(x.strip() for x in held))
            # in a tight item a paragraph is bare text, to which a list joins on
            out.append(text if tight else f"<p>{text}</p>" + "\n")
            held.clear()

    at = 0
    while at < len(lines):
        line = lines[at]
        fence = FENCE.match(line)
        heading = re.match(r"(#{1,6})[ ]*(.+?)[ ]*#*\Z", line)
        if not line.strip():
            end()
            at += 1
        elif fence and any(re.fullmatch(rf"{re.escape(fence[1][0])}{{{len(fence[1])},}}\s*", x) for x in lines[at + 1 :]):
            end()
            close = next(k for k in range(at + 1, len(lines)) if re.fullmatch(rf"{re.escape(fence[1][0])}{{{len(fence[1])},}}\s*", lines[k]))
            kind = f' class="language-{escape(fence[2])}"' if fence[2] else ""
            body = "".join(escape(x, quote=False) + "\n" for x in lines[at + 1 : close])
            out.append(f"<pre><code{kind}>{body}</code></pre>\n")
            at = close + 1
        elif heading:
            end()
            out.append(f"<h{len(heading[1])}>{inline(heading[2])}</h{len(heading[1])}>\n")
            at += 1
        elif RULE.match(line) and not held:
            out.append("<hr />\n")
            at += 1
        elif line.lstrip(" ").startswith(">") and depth < DEEPEST:
            end()
            own = []
            while at < len(lines) and lines[at].strip() and (lines[at].lstrip(" ").startswith(">") or own):
                own.append(re.sub(r"\A[ ]{0,3}>[ ]?", "", lines[at]))
                at += 1
            out.append(f"<blockquote>\n{blocks(own, depth + 1)}</blockquote>\n")
        elif ITEM.match(line) and depth < DEEPEST and (tight or not held):
            end()
            made, at = lists(lines, at, depth)
            out.append(made + "\n")
        elif not held and "|" in line and at + 1 < len(lines) and DIVIDER.match(lines[at + 1]) and "-" in lines[at + 1] and len(cells(line)) == len(cells(lines[at + 1])):
            last = next((k for k in range(at + 2, len(lines)) if not lines[k].strip() or "|" not in lines[k]), len(lines))
            out.append(table(lines[at:last]) + "\n")
            at = last
        elif not held and HTML_BLOCK.match(line):
            last = next((k for k in range(at + 1, len(lines)) if not lines[k].strip()), len(lines))
            out.append("\n".join(lines[at:last]) + "\n")
            at = last
        elif indent(line) >= 4 and not held and not tight:
            last = next((k for k in range(at, len(lines)) if lines[k].strip() and indent(lines[k]) < 4), len(lines))
            body = [x[4:] for x in lines[at:last]]
            while body and not body[-1].strip():
                body.pop()
            out.append(f"<pre><code>{escape(chr(10).join(body), quote=False)}\n</code></pre>\n")
            at = last
        else:
            held.append(line)
            at += 1
    end()
    return "".join(out)


def to_html(text: str | None) -> str | None:
    """Null for null; tabs are four spaces."""
    return None if text is None else blocks(text.replace("\r\n", "\n").replace("\r", "\n").expandtabs(4).split("\n")).removesuffix("\n")


@F.pandas_udf(StringType())
def markdown_html(text: pd.Series) -> pd.Series:
    return text.map(to_html)
