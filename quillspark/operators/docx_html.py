"""A document's XML as HTML and formulas: the subset that the publicly documented converters keep.

Heading styles, bold and italic runs, list paragraphs, hyperlinks, tables, line breaks, pictures.
Formulas leave marks ``⟦MT:id⟧``; ids go to display formulas first, then to loose ones, then to
embedded equation objects, each in document order.  Pictures are numbered as they occur.
"""

from __future__ import annotations

import hashlib
import re
import xml.etree.ElementTree as ET
from html import escape

from ..sources.docx import Package, _q, parse, part_of, split_tag, targets
from .omml import convert

EQUATIONS = ("equation.dsmt4", "equation.dsmt3", "equation.3", "equation.2", "mathtype.equation")


def _program(obj: ET.Element) -> str:
    for el in obj.iter():
        for key, value in el.attrib.items():
            if key.endswith("ProgID") or "Equation" in value:
                return value
    return ""


def _rid(el: ET.Element) -> str:
    return el.get(_q("r:id")) or el.get(_q("r:embed")) or ""


def _first(values) -> str | None:
    return next(filter(None, values), None)


def formulas(root: ET.Element, media: Media) -> tuple[dict[ET.Element, str], list[dict]]:
    """Which elements are formulas, and a row for each in the order of ids.

    An object has its preview picture's part and digest, the style of its shape, and the part it is embedded in.
    """
    shown = list(root.iter(_q("m:oMathPara")))
    held = {m for p in shown for m in p.iter(_q("m:oMath"))}
    loose = [m for m in root.iter(_q("m:oMath")) if m not in held]
    objects = [o for o in root.iter(_q("w:object")) if any(p in _program(o).lower() for p in EQUATIONS)]
    marks, rows = {}, []
    for n, el in enumerate([*shown, *loose, *objects], 1):
        is_math = el.tag != _q("w:object")
        marks[el] = f"⟦MT:{n:03d}⟧"
        row = {"formula_id": f"{n:03d}", "display": el.tag == _q("m:oMathPara"), "source": "omml" if is_math else "mathtype"}
        if is_math:
            row["latex"] = re.sub(r"\s+", " ", convert(el)).strip() or None
        else:
            picture = media.part(_first(map(_rid, el.iter(_q("v:imagedata")))))
            # by the first shape that gives both sides
            row["style"] = _first(s if (s := x.get("style") or "") and "width" in s and "height" in s else None for x in el.iter(_q("v:shape")))
            row |= {"picture": picture, "sha1": media.digest(picture), "object": media.part(_first(map(_rid, el.iter(_q("o:OLEObject")))))}
        rows.append(row)
    return marks, rows


#: Extensions that files of a picture get; a part of another kind counts as PNG.
EXTENSIONS = {"png": ".png", "jpeg": ".jpg", "jpg": ".jpg", "gif": ".gif", "bmp": ".bmp", "emf": ".emf", "wmf": ".wmf"}


class Media:
    """A document's relationships and the parts that are there."""

    def __init__(self, package: Package | None, rels: bytes | None = None, folder: str = "image") -> None:
        self.package, self.folder = package, folder
        self.targets = targets(rels if rels is not None else package and package.read("word/_rels/document.xml.rels"))
        self.images: list[dict] = []

    def part(self, rid: str | None) -> str | None:
        target = self.targets.get(rid or "")
        part = part_of(target) if target else None
        return part if part and self.package is not None and part in self.package.items else None

    def digest(self, part: str | None) -> str | None:
        data = self.package.read(part) if part else None
        return None if data is None else hashlib.sha1(data).hexdigest()

    def image(self, rid: str) -> str:
        """The file that a picture goes to; where its part is missing, its target as it stands."""
        part = self.part(rid)
        if part is None:
            return self.targets.get(rid, "")
        number, ext = f"{len(self.images) + 1:03d}", EXTENSIONS.get(part.rpartition(".")[2].lower(), ".png")
        name = ("glyph" if ext in (".wmf", ".emf") else "image") + number + ext
        self.images.append({"image_id": number, "name": name, "part": part, "sha1": self.digest(part)})
        return f"{self.folder}/{name}"


class Writer:
    def __init__(self, marks: dict[ET.Element, str], media: Media) -> None:
        self.marks, self.media = marks, media

    def children(self, el: ET.Element) -> str:
        return "".join(map(self.inline, el))

    def inline(self, el: ET.Element) -> str:
        if el in self.marks:
            return self.marks[el]
        name = split_tag(el.tag)[1]
        if name == "t":
            return escape(el.text or "", quote=False)
        if name in ("br", "cr"):
            return "<br />"
        if name == "tab":
            return "\t"
        if name == "r":
            text = self.children(el)
            for tag, flag in (("em", "i"), ("strong", "b")):
                mark = el.find(f"{_q('w:rPr')}/{_q('w:' + flag)}")
                if text and mark is not None and mark.get(_q("w:val")) not in ("0", "false"):
                    text = f"<{tag}>{text}</{tag}>"
            return text
        if name == "hyperlink":
            href = self.media.targets.get(el.get(_q("r:id")) or "", "")
            return f'<a href="{escape(href)}">{self.children(el)}</a>' if href else self.children(el)
        if name in ("blip", "imagedata"):
            src = self.media.image(_rid(el))
            return f'<img src="{escape(src)}" />' if src else ""
        if name in ("del", "rPr", "pPr", "instrText", "delText"):
            return ""
        return self.children(el)

    def block(self, el: ET.Element) -> str:
        name = split_tag(el.tag)[1]
        if el in self.marks:
            return f"<p>{self.marks[el]}</p>"
        if name == "p":
            style = el.find(f"{_q('w:pPr')}/{_q('w:pStyle')}")
            level = re.fullmatch(r"(?i)heading ?([1-6])", style.get(_q("w:val")) or "") if style is not None else None
            text = self.children(el)
            if not text:
                return ""
            if el.find(f"{_q('w:pPr')}/{_q('w:numPr')}") is not None:
                return f"<li>{text}</li>"
            return f"<h{level[1]}>{text}</h{level[1]}>" if level else f"<p>{text}</p>"
        if name == "tbl":
            cell = lambda c: "<td>" + " ".join(filter(None, (re.sub(r"^<p>|</p>$", "", self.block(p)) for p in c if split_tag(p.tag)[1] in ("p", "tbl")))) + "</td>"
            rows = ["<tr>" + "".join(map(cell, row.iter(_q("w:tc")))) + "</tr>" for row in el.iter(_q("w:tr"))]
            return "<table>" + "".join(rows) + "</table>"
        return "".join(map(self.block, el)) if name in ("body", "sdt", "sdtContent", "ins", "document") else ""


def to_html(xml: bytes | str | None, media: Media) -> tuple[str | None, list[dict]]:
    """HTML and formula rows; None for what is no XML.  Pictures met are left in ``media.images``."""
    root = parse(xml)
    if root is None:
        return None, []
    marks, rows = formulas(root, media)
    body = root.find(_q("w:body"))
    html = Writer(marks, media).block(root if body is None else body)
    return re.sub(r"(?:<li>.*?</li>)+", lambda m: f"<ul>{m[0]}</ul>", html, flags=re.S), rows
