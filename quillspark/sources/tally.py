"""Counts of a Word file's parts by a counting automaton over XML events: one small row per part, no row per element.

What an element adds depends on what is open around it: display formulas, paragraphs with their style and what they hold, sections
with their type.  A part that is no XML adds nothing but its name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from xml.parsers import expat

from pyspark.sql import DataFrame

from .docx import NS, Package, _each, _margin

#: Namespace and a closing brace -> prefix.
PREFIX = {uri + "}": f"{prefix}:" for prefix, uri in NS.items()}
W_TYPE, W_VAL = f"{NS['w']}}}type", f"{NS['w']}}}val"
NOTES = {"word/footnotes.xml": "w:footnote", "word/endnotes.xml": "w:endnote"}
SEPARATORS = ("separator", "continuationSeparator")
HOLDS = frozenset(("w:object", "m:oMath", "wp:inline", "v:imagedata"))
SCHEMA = "part string, tally map<string,long>, said string, image boolean, pages boolean, longest long, kinds map<string,long>, raw string, error string"


class Tally:
    """One part's counts."""

    def __init__(self, part: str) -> None:
        self.part, self.count, self.kinds = part, Counter(), Counter()
        self.body = part == "word/document.xml"
        #: names of the open elements
        self.open: list[str] = []
        #: open paragraphs: number, text, style, whether an object is in it
        self.paragraphs: list[list] = []
        self.empty: list[bool] = []
        self.sections: list[int] = []
        self.said: list[str] = []
        self.shown = 0
        self.text: list[str] | None = None
        self.pages = False

    def start(self, name: str, attrs: dict[str, str]) -> None:
        self._say()
        at = name.rfind("}") + 1
        tag = PREFIX.get(name[:at], "?:") + name[at:]
        self.count[tag] += 1
        if self.body:
            self._in_body(tag, attrs)
        elif tag == NOTES.get(self.part) and attrs.get(W_TYPE, "") not in SEPARATORS:
            self.count["note"] += 1
        self.open.append(tag)
        self.text = []

    def _in_body(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "m:oMath" and not self.shown:
            self.count["inline"] += 1
        elif tag == "m:oMathPara":
            self.shown += 1
        elif tag == "w:br" and attrs.get(W_TYPE) == "page":
            self.count["page"] += 1
        elif tag == "o:OLEObject":
            program = attrs.get("ProgID", "")
            own = "DSMT" in program or "MathType" in program
            self.count["mathtype"] += own
            self.count["equation"] += not own and program.startswith("Equation.")
        elif tag == "w:p":
            self.paragraphs.append([len(self.empty), [], None, False])
            self.empty.append(False)
        elif tag == "w:pStyle" and self.open[-2:] == ["w:p", "w:pPr"] and self.paragraphs[-1][2] is None:
            self.paragraphs[-1][2] = attrs.get(W_VAL, "")
        elif tag == "w:sectPr":
            self.sections.append(0)
        elif tag == "w:type" and self.open[-1:] == ["w:sectPr"]:
            self.sections[-1] += 1
            self.kinds[attrs.get(W_VAL) or ""] += 1
        if tag in HOLDS:
            for p in self.paragraphs:
                p[3] = True

    def chars(self, text: str) -> None:
        if self.text is not None:
            self.text.append(text)

    def _say(self) -> None:
        """The text before an element's first child is its own; that after a child is nobody's."""
        if self.text:
            text = "".join(self.text)
            if self.body:
                if self.open[-1] == "w:t":
                    for p in self.paragraphs:
                        p[1].append(text)
            else:
                self.said.append(text)
                self.pages = self.pages or "PAGE" in text
        self.text = None

    def end(self, _: str) -> None:
        self._say()
        tag = self.open.pop()
        if not self.body:
            return
        if tag == "m:oMathPara":
            self.shown -= 1
        elif tag == "w:p":
            n, text, style, holds = self.paragraphs.pop()
            self.empty[n] = not holds and not "".join(text).strip()
            self.count["heading"] += style is not None and (style.lower().startswith("heading") or "标题" in style)
        elif tag == "w:sectPr" and not self.sections.pop():
            self.kinds[""] += 1

    def longest(self) -> int:
        most = now = 0
        for empty in self.empty:
            now = now + 1 if empty else 0
            most = max(most, now)
        return most


def tallied(part: str, data: bytes | None) -> Tally | None:
    tally, parser = Tally(part), expat.ParserCreate(namespace_separator="}")
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = tally.start, tally.end, tally.chars
    parser.buffer_text = True
    try:
        parser.Parse(data or b"", True)
    except (expat.ExpatError, ValueError):
        return None
    return tally


def _tallies(content: bytes | None) -> Iterator[dict]:
    package = Package(content)
    if not package.items:
        yield {"error": "no zip file" if package.zip is None else "no word/document.xml"}
    for part in package.items:
        row = {"part": part}
        if part == "word/document.xml" or part in NOTES or _margin(part):
            data = package.read(part)
            made = tallied(part, data)
            if part == "word/document.xml":
                row |= {"raw": None if data is None else data.decode("utf-8", "replace"), "error": "no word/document.xml" if data is None else None if made else "word/document.xml is no XML"}
            if made:
                row |= {"tally": list(made.count.items()), "said": "".join(made.said), "image": bool(made.count["v:imagedata"] or made.count["a:blip"]), "pages": made.pages}
                if made.body:
                    made.count["paragraph"], made.count["empty"] = len(made.empty), sum(made.empty)
                    row |= {"tally": list(made.count.items()), "longest": made.longest(), "kinds": list(made.kinds.items())}
        yield row
    if package.items and "word/document.xml" not in package.items:
        yield {"error": "no word/document.xml"}


def tallies(docs: DataFrame, by: str = "doc_id", content: str = "content") -> DataFrame:
    """A row per part of each file: its name, counts, what a header or footer says, the longest run of empty paragraphs,
    the sections by type, and the body as text; one with ``error`` for what can't be read.  Pictures and other binary parts stay packed."""
    return _each(docs, [by], content, _tallies, SCHEMA)
