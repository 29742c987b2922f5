"""HTML to Markdown with its structure kept: a stack automaton over tag tokens.

Formulas between dollars are parked first and put back last, so nothing in them is escaped or read as a tag.  White space is collapsed over the
tokens as a browser shows it.  Then every open element holds what its children have become; when it ends, its rule makes
Markdown of that and hands it to the element below: paragraphs, headings, quotes, nested and numbered lists, rules, fenced and
inline code, links, emphasis, pictures.  Lists and items wait for what follows them before they are joined.  Missing and crossed end tags are repaired as
browsers do for paragraphs and items; an end without a start is passed over.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements that stand on lines of their own, have no end, or mean something without text.
BLOCK = frozenset(
    "address article aside audio blockquote body canvas center dd dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html isindex li main menu nav noframes noscript ol output p pre section table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col command embed hr img input keygen link meta param source track wbr".split())
TELLING = frozenset("a table thead tbody tfoot th td iframe script audio video".split())
HIDDEN = frozenset("script style head title template".split())
#: A paragraph ends where one of these begins.
ENDS_PARAGRAPH = BLOCK - frozenset("audio body canvas frameset html isindex li noframes noscript output tbody td tfoot th thead tr".split()) | {"li"}
#: What Markdown would read as marks: anywhere, and at the beginning of a text.
ESCAPES = [(re.compile(p), r) for p, r in (
    (r"\\", r"\\\\"), (r"\*", r"\\*"), (r"\A-", r"\\-"), (r"\A\+ ", r"\\+ "), (r"\A(=+)", r"\\\1"), (r"\A(#{1,6}) ", r"\\\1 "), (r"`", r"\\`"), (r"\A~~~", r"\\~~~"),
    (r"\[", r"\\["), (r"\]", r"\\]"), (r"\A>", r"\\>"), (r"_", r"\\_"), (r"\A([0-9]+)\. ", r"\1\\. "),
)]
NO_NAME = "配图"

FORMULA = re.compile(r"\$\$[\s\S]+?\$\$|\$[^$\n]+\$")
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|[^<]++|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")


@dataclass
class Open:
    """An open element: its children's Markdown, of which the last may wait for what follows."""

    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    pieces: list[str] = field(default_factory=list)
    #: Line ends after the pieces.
    tail: int = 0
    #: Text as it stands, for code.
    raw: list[str] = field(default_factory=list)
    #: Whether something shows, beyond white space.
    shows: bool = False
    items: int = 0
    #: Markdown of the last child where it is a list in an item, and whether an item ended without a new line.
    list_last: str | None = None
    unended: bool = False
    first: str | None = None


def add(e: Open, text: str) -> None:
    """A piece after as many line ends as the greater of what was before and the piece asks for, two at most."""
    body = text.lstrip("\n")
    n = min(2, max(e.tail, len(text) - len(body)))
    core = body.rstrip("\n")
    if core:
        e.pieces.append("\n" * n + core)
        n = len(body) - len(core)
    e.tail = n


def settle(e: Open, more: bool) -> None:
    """What waited is joined, now that it is known whether ``more`` follows."""
    if e.list_last is not None:
        waiting, e.list_last = e.list_last, None
        add(e, f"\n\n{waiting}\n\n" if more else "\n" + waiting)
    if e.unended:
        e.tail, e.unended = e.tail + more, False


def item(content: str, parent: Open) -> str:
    content = re.sub(r"\n+\Z", "\n", content.lstrip("\n")).replace("\n", "\n    ")
    if parent.name != "ol":
        return "-   " + content
    start = parent.attrs.get("start", "")
    return f"{(int(start) if re.fullmatch('-?[0-9]{1,9}', start) else 1) + parent.items}.  {content}"


def inline_code(text: str) -> str:
    if not text:
        return ""
    text = re.sub(r"\r?\n|\r", " ", text)
    pad = " " if re.search(r"\A`|\A .*?[^ ].* \Z|`\Z", text) else ""
    fence = "`"
    while fence in re.findall("`+", text):
        fence += "`"
    return fence + pad + text + pad + fence


def fenced(text: str, language: str) -> str:
    fence = "`" * max([3, *(len(m) + 1 for m in re.findall(r"(?m)^`{3,}", text))])
    return f"\n\n{fence}{language}\n{text.removesuffix(chr(10))}\n{fence}\n\n"


def link(content: str, attrs: dict[str, str]) -> str:
    title = re.sub(r"(\n+\s*)+", "\n", attrs.get("title", "")).replace('"', '\\"')
    return f"[{content}]({re.sub(r'([()])', lambda m: chr(92) + m[0], attrs['href'])}{f' {chr(34)}{title}{chr(34)}' if title else ''})"


def picture(attrs: dict[str, str]) -> str:
    return f"\n\n![{attrs.get('alt') or NO_NAME}]({attrs['src']})\n\n" if attrs.get("src") else ""


def replaced(e: Open, parent: Open, in_pre: bool) -> str:
    """The Markdown of an element that ends."""
    name, content = e.name, "".join(e.pieces) + "\n" * e.tail
    block = name in BLOCK
    if not e.shows and name not in TELLING:
        return "\n\n" if block else ""
    lead = trail = ""
    if not block:
        inner = content.strip()
        if inner != content:
            lead = content[: len(content) - len(content.lstrip())]
            trail = content[len(content.rstrip()) :] if inner else ""
            content = inner
    if name == "p":
        return f"\n\n{content}\n\n"
    if re.fullmatch("h[1-6]", name):
        return f"\n\n{'#' * int(name[1])} {content}\n\n"
    if name == "blockquote":
        return "\n\n" + re.sub("(?m)^", "> ", content.strip("\n")) + "\n\n"
    if name in ("ul", "ol"):
        return f"\n\n{content}\n\n"
    if name == "li":
        return item(content, parent)
    if name == "pre" and e.first == "code":
        return fenced("".join(e.raw), e.attrs.get("language", ""))
    if name in ("em", "i", "strong", "b"):
        mark = "*" if name in ("em", "i") else "**"
        return lead + (mark + content + mark if content.strip() else "") + trail
    if name == "code" and not in_pre:
        return lead + inline_code(content) + trail
    if name == "a" and e.attrs.get("href"):
        return lead + link(content, e.attrs) + trail
    return f"\n\n{content}\n\n" if block else lead + content + trail


def tokens(page: str) -> list[list]:
    """``[kind, name or text, attributes]`` with white space collapsed; kind is text, start or end."""
    out: list[list] = []
    last: list | None = None
    keep, pre, hidden = False, 0, None
    for m in TOKEN.finditer(page):
        name = (m[2] or "").lower()
        if not name:
            if hidden or m[0].startswith("<!"):
                continue
            text = html.unescape(m[0])
            if not pre:
                text = re.sub(r"[ \r\n\t]+", " ", text)
                if (last is None or last[1].endswith(" ")) and not keep and text.startswith(" "):
                    text = text[1:]
            if text:
                out.append(["text", text, None])
                last, keep = (None, True) if pre else (out[-1], False)
            continue
        ends = bool(m[1])
        if name in HIDDEN:
            hidden = None if ends and hidden == name else hidden if ends else hidden or name
            continue
        if hidden:
            continue
        if name in BLOCK or name == "br":
            if last is not None:
                last[1] = last[1].removesuffix(" ")
            last, keep = None, False
        elif name in VOID:
            last, keep = None, True
        if name == "pre":
            pre = max(0, pre + (-1 if ends else 1))
        attrs = {} if ends else {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in ATTRIBUTE.finditer(m[3])}
        if not ends or name not in VOID:
            out.append(["end" if ends else "start", name, attrs])
    if last is not None:
        last[1] = last[1].removesuffix(" ")
    return [t for t in out if t[1]]


def convert(page: str) -> str:
    root = Open("")
    stack = [root]
    pre = code = 0

    def give(text: str, shows: bool) -> None:
        top = stack[-1]
        settle(top, True)
        add(top, text)
        top.shows |= shows

    def end() -> None:
        nonlocal pre, code
        e = stack.pop()
        settle(e, False)
        top = stack[-1]
        pre -= e.name == "pre"
        code -= e.name == "code"
        if e.name == "code" or code:
            top.raw += e.raw
        if e.name == "code" and top.name == "pre" and top.first == "code":
            language = re.search(r"language-(\S+)", e.attrs.get("class", ""))
            top.attrs["language"] = language[1] if language else ""
        text = replaced(e, top, pre > 0)
        telling = e.shows or e.name in TELLING
        if e.name in ("ul", "ol") and top.name == "li" and e.shows:
            settle(top, True)
            top.list_last = text.strip("\n")
            top.shows = True
        else:
            give(text, telling)
        if e.name == "li":
            top.items += 1
            top.unended = e.shows and not text.endswith("\n")

    def close(names: set[str], within: frozenset[str] | set[str]) -> None:
        """End the innermost of these elements and all in it, if it is open within none of ``within``."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                while len(stack) > k:
                    end()
                return
            if stack[k].name in within:
                return

    for kind, name, attrs in tokens(page):
        if kind == "text":
            if code:
                stack[-1].raw.append(name)
            text = name
            if not code:
                for pattern, by in ESCAPES:
                    text = pattern.sub(by, text)
            give(text, bool(name.strip()))
            stack[-1].first = stack[-1].first or "text"
        elif kind == "end":
            if any(e.name == name for e in stack):
                close({name}, {"td", "th"} - {name} if name not in ("table", "tr", "tbody", "thead", "tfoot") else set())
        else:
            if name in ENDS_PARAGRAPH:
                close({"p"}, BLOCK - {"p"})
            if name == "li":
                close({"li"}, {"ul", "ol", "menu", "dir"})
            elif name in ("td", "th"):
                close({"td", "th"}, {"tr", "table"})
            elif name == "tr":
                close({"tr"}, {"table", "thead", "tbody", "tfoot"})
            stack[-1].first = stack[-1].first or name
            if name in VOID:
                give("  \n" if name == "br" else "\n\n* * *\n\n" if name == "hr" else picture(attrs) if name == "img" else "", True)
            else:
                pre += name == "pre"
                code += name == "code"
                stack.append(Open(name, attrs))
    while len(stack) > 1:
        end()
    settle(root, False)
    return re.sub(r"\s+\Z", "", re.sub(r"\A[\t\r\n]+", "", "".join(root.pieces)))


def to_markdown(page: str | None) -> str | None:
    if page is None:
        return None
    slots: list[str] = []
    park = lambda m: f"@@LATEX{len(slots)}@@{slots.append(m[0]) or ''}"
    text = convert(FORMULA.sub(park, page))
    return re.sub(r"@@LATEX([0-9]+)@@", lambda m: slots[int(m[1])] if int(m[1]) < len(slots) else "", text)


@F.pandas_udf(StringType())
def structured_markdown(page: pd.Series) -> pd.Series:
    return page.map(to_markdown)
