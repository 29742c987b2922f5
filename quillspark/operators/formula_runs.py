"""Word files with their formulas replaced by text: an event-stream rewriter that keeps every other byte.

The document is read once as events.  Of formulas and equation objects only the byte span, the namespaces in force and what an object
is made by are kept; no tree of the document is built.  Then the bytes between the outermost spans are copied and a run with the text
is put for each.  Ids go to display formulas first, then to loose ones, then to objects.  A part that is no XML, or
has none of them, stays as it is, and so does the whole file.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import escape
from xml.parsers import expat
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.docx import NS, Package, zipped
from .docx_html import EQUATIONS
from .omml import convert

BODY = "word/document.xml"
TAG = re.compile(rb"""<(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
FORMULA = "array<struct<formula_id:string,latex:string,display:boolean,source:string>>"


@dataclass
class Span:
    kind: str
    start: int
    end: int = 0
    names: dict[str, str] = field(default_factory=dict)
    program: str | None = None


def spans(xml: bytes) -> list[Span]:
    """Display formulas, loose formulas and equation objects, each kind in document order."""
    parser = expat.ParserCreate(namespace_separator="}")
    wanted = {f"{NS['m']}}}oMathPara": "para", f"{NS['m']}}}oMath": "math", f"{NS['w']}}}object": "object"}
    scope: list[tuple[str, str | None]] = []
    names: dict[str, str] = {}
    open_, found = [], []

    def declare(prefix: str | None, uri: str | None) -> None:
        scope.append((prefix or "", names.get(prefix or "")))
        names[prefix or ""] = uri or ""

    def undeclare(_: str | None) -> None:
        prefix, before = scope.pop()
        if before is None:
            names.pop(prefix, None)
        else:
            names[prefix] = before

    def start(name: str, attrs: dict[str, str]) -> None:
        for span in open_:
            if span.kind == "object" and span.program is None:
                span.program = next((v for k, v in attrs.items() if k.endswith("ProgID") or "Equation" in v), None)
        kind = wanted.get(name)
        if kind:
            span = Span(kind, parser.CurrentByteIndex, names=dict(names))
            if kind == "object":
                span.program = next((v for k, v in attrs.items() if k.endswith("ProgID") or "Equation" in v), None)
            if not (kind == "math" and any(s.kind == "para" for s in open_)):
                found.append(span)
            open_.append(span)

    def end(name: str) -> None:
        if name in wanted:
            span = open_.pop()
            opening = TAG.match(xml, span.start)
            span.end = (opening if opening[0].endswith(b"/>") else TAG.match(xml, parser.CurrentByteIndex)).end()

    parser.StartNamespaceDeclHandler, parser.EndNamespaceDeclHandler = declare, undeclare
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.Parse(xml, True)
    kept = [s for s in found if s.kind != "object" or any(p in (s.program or "").lower() for p in EQUATIONS)]
    return sorted(kept, key=lambda s: ("para", "math", "object").index(s.kind))


def latex_of(xml: bytes, span: Span) -> str | None:
    declared = " ".join(f"xmlns{':' if p else ''}{p}={quoteattr(u)}" for p, u in span.names.items() if p != "xml")
    root = ET.fromstring(b"<x " + declared.encode() + b">" + xml[span.start : span.end] + b"</x>")
    return re.sub(r"\s+", " ", convert(root[0])).strip() or None


def run(text: str, names: dict[str, str]) -> bytes:
    prefix = next((p for p, u in names.items() if p and u == NS["w"]), None)
    declared, prefix = ("", prefix) if prefix else (f' xmlns:w="{NS["w"]}"', "w")
    return f'<{prefix}:r{declared}><{prefix}:t xml:space="preserve">{escape(text, quote=False)}</{prefix}:t></{prefix}:r>'.encode()


def as_utf8(xml: bytes) -> bytes:
    """The part in UTF-8; only one in UTF-16 is changed."""
    if xml[:2] not in (b"\xff\xfe", b"\xfe\xff"):
        return xml
    return re.sub(r"""\A(<\?xml[^>]*?)\s+encoding\s*=\s*(?:"[^"]*"|'[^']*')""", r"\1", xml.decode("utf-16")).encode()


Text = Callable[[dict], "str | None"]


def rewritten(xml: bytes | None, text: Text, objects: bool) -> tuple[bytes | None, list[dict]]:
    """The part with each formula's ``text`` (null: nothing) in its place, and the formulas in the order of their ids."""
    try:
        xml = as_utf8(xml or b"")
        told = [s for s in spans(xml) if objects or s.kind != "object"]
        rows = [{"formula_id": f"{n:03d}", "latex": latex_of(xml, s) if s.kind != "object" else None, "display": s.kind == "para", "source": "mathtype" if s.kind == "object" else "omml"} for n, s in enumerate(told, 1)]
    except (expat.ExpatError, ET.ParseError, UnicodeDecodeError):
        return None, []
    out, at = [], 0
    for span, row in sorted(zip(told, rows, strict=True), key=lambda x: x[0].start):
        if span.start < at:  # within another
            continue
        put = text(row)
        out += [xml[at : span.start], run(put, span.names) if put else b""]
        at = span.end
    return b"".join([*out, xml[at:]]), rows


def marked(row: dict) -> str:
    return f"⟦MT:{row['formula_id']}⟧"


def inlined(row: dict) -> str | None:
    sign = "$$" if row["display"] else "$"
    return row["latex"] and sign + row["latex"] + sign


def _files(docs: DataFrame, by: str, text: Text, objects: bool) -> DataFrame:
    kind = docs.schema[by].dataType.simpleString()
    item = pa.list_(pa.struct([("formula_id", pa.string()), ("latex", pa.string()), ("display", pa.bool_()), ("source", pa.string())]))

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, found = [], []
            for value in batch.column(1):
                content = value.as_py()
                package = Package(content)
                body, rows = rewritten(package.read(BODY), text, objects)
                if rows:
                    content = zipped((p, body if p == BODY else package.read(p) or b"") for p in package.items)
                contents.append(content)
                found.append(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.binary()), pa.array(found, item)], names=[by, "content", "formulas"])

    return docs.select(by, "content").mapInArrow(run_, f"{by} {kind}, content binary, formulas {FORMULA}")


def with_marks(docs: DataFrame, by: str = "doc_id") -> DataFrame:
    """``doc_id, content, formulas``: files whose formulas and equation objects are runs with marks ``⟦MT:id⟧``."""
    return _files(docs, by, marked, True)


def with_latex(docs: DataFrame, by: str = "doc_id") -> DataFrame:
    """``doc_id, content, formulas``: files whose formulas are runs with ``$LaTeX$``, or ``$$LaTeX$$`` where displayed; those without any go."""
    return _files(docs, by, inlined, False)
