"""Office Math XML to LaTeX: a table of templates over an element's named children."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources.docx import NS, parse, split_tag

# Symbols and the commands that stand for them, characters that LaTeX escapes.
SYMBOLS = {
    "∑": "\\sum ", "∏": "\\prod ", "∫": "\\int ", "∞": "\\infty ", "≤": "\\le ", "≥": "\\ge ", "≠": "\\ne ", "±": "\\pm ",
    "×": "\\times ", "÷": "\\div ", "·": "\\cdot ", "∈": "\\in ", "⊂": "\\subset ", "∪": "\\cup ", "∩": "\\cap ", "π": "\\pi ",
    "α": "\\alpha ", "β": "\\beta ", "θ": "\\theta ", "Δ": "\\Delta ", "→": "\\to ", "⇒": "\\Rightarrow ",
}
ESCAPED = "#$%&_{}"
# What an element with one of each named child becomes; <x> is that child's LaTeX.
TEMPLATES = {
    "f": r"\dfrac{<num>}{<den>}",
    "sSup": "{<e>}^{<sup>}",
    "sSub": "{<e>}_{<sub>}",
    "sSubSup": "{<e>}_{<sub>}^{<sup>}",
    "limLow": r"\lim_{<lim>}{<e>}",
    "bar": r"\overline{<e>}",
    "acc": r"\hat{<e>}",
}
FUNCTIONS = ("sin", "cos", "tan", "log", "ln", "lim")
N_ARY = {"∫": "\\int ", "∏": "\\prod "}

_TABLE = str.maketrans({**SYMBOLS, **{c: "\\" + c for c in ESCAPED}, "​": ""})


def _name(el: ET.Element) -> str:
    return split_tag(el.tag)[1]


def _named(el: ET.Element, name: str) -> list[ET.Element]:
    return [c for c in el if _name(c) == name]


def _words(el: ET.Element) -> str:
    return "".join(el.itertext()).translate(_TABLE)


def _inside(el: ET.Element, name: str) -> str:
    """The LaTeX of the first child of that name, or nothing."""
    return "".join(convert(c) for c in _named(el, name)[:1])


def _radical(el: ET.Element) -> str:
    degree = _named(el, "deg")[:1]
    shown = degree and "".join(degree[0].itertext()).replace("​", "").strip()
    return (rf"\sqrt[{convert(degree[0])}]" if shown else r"\sqrt") + "{" + _inside(el, "e") + "}"


def _sum(el: ET.Element) -> str:
    marks = [c for p in _named(el, "naryPr")[:1] for c in _named(p, "chr")[:1]]
    sign = next((m.get(f"{{{NS['m']}}}val") or m.get("val") for m in marks), None)
    return N_ARY.get(sign or "", "\\sum ") + "_{" + _inside(el, "sub") + "}^{" + _inside(el, "sup") + "}{" + _inside(el, "e") + "}"


def _function(el: ET.Element) -> str:
    name = _inside(el, "fName").strip()
    return ("\\" + name if name in FUNCTIONS else rf"\operatorname{{{name}}}") + "{" + _inside(el, "e") + "}"


SPECIAL = {
    "t": _words,
    "r": lambda el: _words(_named(el, "t")[0]) if _named(el, "t") else "".join(map(convert, el)),
    "rad": _radical,
    "nary": _sum,
    "func": _function,
    "d": lambda el: r"\left(" + ",".join(map(convert, _named(el, "e"))) + r"\right)",
    "eqArr": lambda el: r"\begin{aligned}" + r" \\ ".join(map(convert, _named(el, "e"))) + r"\end{aligned}",
}
#: Elements that only hold others; unlike an unknown element they are empty without children.
HOLDERS = frozenset("oMath oMathPara e deg num den sub sup fName lim".split())


def convert(el: ET.Element) -> str:
    name = _name(el)
    if name in SPECIAL:
        return SPECIAL[name](el)
    if name in TEMPLATES:
        return re.sub(r"<(\w+)>", lambda m: _inside(el, m[1]), TEMPLATES[name])
    return "".join(map(convert, el)) if len(el) or name in HOLDERS else _words(el)


@lru_cache(maxsize=20_000)
def to_latex(xml: str | None) -> str | None:
    """Null for what is no XML; white space collapsed."""
    root = parse(xml)
    return None if root is None else re.sub(r"\s+", " ", convert(root)).strip()


@F.pandas_udf(StringType())
def omml_to_latex(xml: pd.Series) -> pd.Series:
    return xml.map(to_latex)
