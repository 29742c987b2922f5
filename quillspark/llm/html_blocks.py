"""Leaf blocks of a web page: runs of text between borders of block elements, with what stands above and in them.

The reader follows the HTML standard where it decides where text belongs: comments, raw text elements, void elements, end tags that
are implied or missing, quoted attributes; a tag that never ends takes the rest of the page. It needs one pass and time linear in the
page, whatever its nesting.
"""

from __future__ import annotations

import html
import re
from collections.abc import Container
from dataclasses import dataclass

# Names of elements in the HTML standard.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
HIDDEN = frozenset("script style title textarea template noscript iframe noembed noframes xmp svg math object head".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp noscript".split())
#: An element's start ends an open one of these, up to an element that holds them.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
#: Elements that say what their content is, even without a class.
SECTION = frozenset("article aside dialog footer form header main nav search section".split())
#: A paragraph's end isn't implied across these.
SCOPE = frozenset("td th caption button html table template".split())

TOKEN = re.compile(
    r"""<(?:!--(?:-?>|(?P<comment>.*?)(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|/(?![a-zA-Z])[^>]*+(?:>|\Z)"""
    r"""|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"'=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?|["'])*+)(?:>|\Z))""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


@dataclass
class Element:
    name: str
    #: Features of this element and those above it, each once.
    above: tuple[str, ...]
    #: Features of the nearest element that has a name or says what it holds.
    near: tuple[str, ...]
    links: int


@dataclass
class Block:
    text: str
    tag: str
    above: tuple[str, ...]
    near: tuple[str, ...]
    #: Share of the characters that stand in links.
    linked: float
    label: str | None


def described(name: str, attrs: str) -> list[str]:
    """Features of an element's own tag: its name, words of its class, id, role and property, and whether it is hidden."""
    out = [f"in:{name}"]
    if attrs:
        for m in ATTRIBUTE.finditer(attrs):
            kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if kind in ("hidden", "aria-hidden", "style"):
                if kind == "hidden" or (kind == "aria-hidden" and value.lower() == "true") or re.search(r"display\s*:\s*none", value, re.I):
                    out.append("hidden")
            else:
                out += [f"{'role' if kind == 'role' else 'named'}:{w.lower()}" for w in NAME_PART.findall(value)]
    return out


def leaf_blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """Blocks with text, in page order; ``known``: the only features kept of elements above.

    A comment ``label:x`` labels the blocks after it, as in pages for training.
    """
    stack = [Element("", (), (), 0)]
    out: list[Block] = []
    pieces: list[str] = []
    linked = 0
    hidden = 0
    label = None

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                tag = next((e.name for e in reversed(stack) if e.name in BLOCK), "")
                out.append(Block(text, tag, stack[-1].above, stack[-1].near, min(1.0, linked / len(text)), label))
            pieces.clear()
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal hidden
        for e in stack[k:]:
            hidden -= e.name in HIDDEN
            opened[e.name] -= 1
        del stack[k:]

    opened: dict[str, int] = {}
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        start = m.start() if m else end
        if start > at and not hidden:
            piece = html.unescape(page[at:start])
            pieces.append(piece)
            if stack[-1].links:
                linked += len(piece)
        if m is None:
            break
        at = m.end()
        name = m["name"]
        if name is None:
            if m["comment"] and m["comment"].startswith("label:"):
                flush()
                label = m["comment"][6:]
            continue
        name = name.lower()
        if name == "br" and not hidden:
            pieces.append("\n")
        if m["close"]:
            if name in BLOCK:
                flush()
            if opened.get(name) and name not in ("body", "html"):
                k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name)
                # an inline element doesn't end across a block's border
                if name in BLOCK or name in HIDDEN or not any(e.name in BLOCK for e in stack[k + 1 :]):
                    pop_to(k)
            continue
        if name in BLOCK:
            flush()
            closes, holds = IMPLIED.get(name, ((), ()))
            if any(opened.get(c) for c in closes):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in holds:
                        break
                    if stack[k].name in closes:
                        pop_to(k)
                        break
            elif opened.get("p"):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in SCOPE:
                        break
                    if stack[k].name == "p":
                        pop_to(k)
                        break
        if opened.get("head") and (name in BLOCK or name == "body"):
            flush()
            pop_to(next(k for k in range(1, len(stack)) if stack[k].name == "head"))
        if name in VOID:
            continue
        if name in RAW:
            ended = RAW_END[name].search(page, at)
            at = ended.start() if ended else end
        elif m["attrs"].endswith("/") and name in ("svg", "math", "object"):
            continue
        top = stack[-1]
        own = described(name, m["attrs"])
        near = tuple(f"near:{f}" for f in dict.fromkeys(own)) if len(own) > 1 or name in SECTION else top.near
        new = [f for f in own if (known is None or f in known) and f not in top.above]
        stack.append(Element(name, (*top.above, *dict.fromkeys(new)) if new else top.above, near, top.links + (name == "a")))
        opened[name] = opened.get(name, 0) + 1
        hidden += name in HIDDEN
    flush()
    return out
