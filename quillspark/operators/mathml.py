"""Presentation MathML to LaTeX: a bottom-up transducer, one small rule per element.

Elements are known by their local names, whatever their prefix.  Every rule gets the LaTeX of its children, so a tree is
visited once.  Named character references are decoded first, as MathML writes many that XML doesn't know.  What is no XML, has no
content or is nested deeper than ``DEEPEST`` has no LaTeX (null).
"""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from xml.parsers import expat

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DEEPEST = 200
# The operator dictionary, what LaTeX calls a character of an operator, identifier or number.
OPERATORS = {
    "±": "\\pm ", "∓": "\\mp ", "×": "\\times ", "÷": "\\div ", "·": "\\cdot ", "⋅": "\\cdot ", "∗": "*", "∘": "\\circ ", "−": "-", "⁄": "/", "∕": "/",
    "≤": "\\le ", "≥": "\\ge ", "⩽": "\\leqslant ", "⩾": "\\geqslant ", "≠": "\\ne ", "≡": "\\equiv ", "≈": "\\approx ", "∼": "\\sim ", "≅": "\\cong ", "∝": "\\propto ", "≪": "\\ll ", "≫": "\\gg ",
    "∈": "\\in ", "∉": "\\notin ", "∋": "\\ni ", "⊂": "\\subset ", "⊃": "\\supset ", "⊆": "\\subseteq ", "⊇": "\\supseteq ", "⊄": "\\not\\subset ", "∪": "\\cup ", "∩": "\\cap ", "∖": "\\setminus ", "∅": "\\varnothing ",
    "∀": "\\forall ", "∃": "\\exists ", "¬": "\\neg ", "∧": "\\wedge ", "∨": "\\vee ", "⊕": "\\oplus ", "⊗": "\\otimes ", "⊥": "\\perp ", "∥": "\\parallel ", "∠": "\\angle ", "△": "\\triangle ", "▵": "\\triangle ", "°": "^{\\circ}",
    "→": "\\to ", "←": "\\leftarrow ", "↔": "\\leftrightarrow ", "⇒": "\\Rightarrow ", "⇐": "\\Leftarrow ", "⇔": "\\Leftrightarrow ", "↦": "\\mapsto ", "↑": "\\uparrow ", "↓": "\\downarrow ", "⟶": "\\longrightarrow ", "⟹": "\\Longrightarrow ",
    "∑": "\\sum ", "∏": "\\prod ", "∐": "\\coprod ", "∫": "\\int ", "∬": "\\iint ", "∭": "\\iiint ", "∮": "\\oint ", "⋃": "\\bigcup ", "⋂": "\\bigcap ", "∂": "\\partial ", "∇": "\\nabla ", "√": "\\surd ", "∞": "\\infty ",
    "∴": "\\therefore ", "∵": "\\because ", "…": "\\ldots ", "⋯": "\\cdots ", "⋮": "\\vdots ", "⋱": "\\ddots ", "′": "'", "″": "''", "‴": "'''", "ℏ": "\\hbar ", "ℓ": "\\ell ", "ℜ": "\\Re ", "ℑ": "\\Im ", "ℵ": "\\aleph ",
    "⟨": "\\langle ", "⟩": "\\rangle ", "〈": "\\langle ", "〉": "\\rangle ", "⌊": "\\lfloor ", "⌋": "\\rfloor ", "⌈": "\\lceil ", "⌉": "\\rceil ", "‖": "\\|", "∣": "|", "ⅆ": "d", "ⅇ": "e", "ⅈ": "i",
}
GREEK = "alpha beta gamma delta varepsilon zeta eta theta iota kappa lambda mu nu xi o pi rho varsigma sigma tau upsilon varphi chi psi omega".split()
CAPITALS = {"Γ": "Gamma", "Δ": "Delta", "Θ": "Theta", "Λ": "Lambda", "Ξ": "Xi", "Π": "Pi", "Σ": "Sigma", "Υ": "Upsilon", "Φ": "Phi", "Ψ": "Psi", "Ω": "Omega", "ϕ": "phi", "ϵ": "epsilon", "ϑ": "vartheta", "ϖ": "varpi", "ϱ": "varrho"}
NUMBER_SETS = {"ℝ": "R", "ℕ": "N", "ℤ": "Z", "ℚ": "Q", "ℂ": "C", "ℙ": "P"}
FUNCTIONS = frozenset("sin cos tan cot sec csc arcsin arccos arctan sinh cosh tanh coth log ln lg exp lim liminf limsup max min sup inf det dim gcd arg ker deg hom Pr".split())
LIMITS = frozenset("\\sum \\prod \\coprod \\bigcup \\bigcap \\lim \\liminf \\limsup \\max \\min \\sup \\inf \\det \\gcd \\Pr".split())
OVER = {"^": "\\hat", "ˆ": "\\hat", "¯": "\\overline", "‾": "\\overline", "ˉ": "\\overline", "_": "\\overline", "→": "\\overrightarrow", "⇀": "\\overrightarrow", "←": "\\overleftarrow", "~": "\\tilde", "˜": "\\tilde", "˙": "\\dot", ".": "\\dot", "¨": "\\ddot", "⏞": "\\overbrace", "ˇ": "\\check", "˘": "\\breve", "⌢": "\\overset{\\frown}"}
UNDER = {"_": "\\underline", "¯": "\\underline", "̲": "\\underline", "⏟": "\\underbrace", "→": "\\underrightarrow"}
WIDE = {"\\hat": "\\widehat", "\\tilde": "\\widetilde"}
VARIANTS = {"bold": "mathbf", "italic": "mathit", "double-struck": "mathbb", "script": "mathcal", "fraktur": "mathfrak", "sans-serif": "mathsf", "monospace": "mathtt", "bold-italic": "boldsymbol", "bold-fraktur": "mathfrak", "bold-script": "mathcal"}
ENCLOSED = {"box": "\\boxed", "top": "\\overline", "bottom": "\\underline", "radical": "\\sqrt", "updiagonalstrike": "\\cancel", "downdiagonalstrike": "\\bcancel", "horizontalstrike": "\\sout", "actuarial": "\\overline", "longdiv": "\\overline"}
MATRICES = {("(", ")"): "pmatrix", ("[", "]"): "bmatrix", ("{", "}"): "Bmatrix", ("|", "|"): "vmatrix", ("‖", "‖"): "Vmatrix", ("{", ""): "cases"}
ESCAPES = {"{": "\\{", "}": "\\}", "#": "\\#", "$": "\\$", "%": "\\%", "&": "\\&", "_": "\\_", "\\": "\\backslash ", "~": "\\sim ", "^": "\\wedge "}
INVISIBLE = dict.fromkeys(map(ord, "⁡⁢⁣⁤​﻿"), "")

MATH = str.maketrans({
    **ESCAPES, **OPERATORS,
    **{chr(0x3B1 + k): n if n == "o" else f"\\{n} " for k, n in enumerate(GREEK)},
    **{c: f"\\{n} " for c, n in CAPITALS.items()},
    **{c: f"\\mathbb{{{n}}}" for c, n in NUMBER_SETS.items()},
})
TEXT = str.maketrans({**{k: v for k, v in ESCAPES.items() if k not in "\\~^"}, "\\": "\\textbackslash{}", "~": "\\textasciitilde{}", "^": "\\textasciicircum{}"})
OPENING, CLOSING = "([{⟨〈⌊⌈|‖", ")]}⟩〉⌋⌉|‖"


@dataclass
class Made:
    """An element's LaTeX and what its parent asks of it."""

    name: str
    tex: str
    #: The character of an operator, or the text of a token.
    sign: str = ""
    #: Rows of a table, cells of a row.
    parts: tuple[Made, ...] = ()
    #: Higher than a line, so fences round it grow.
    tall: bool = False
    #: A table alone, apart from what encloses it.
    table: Made | None = None


def joined(children: list[Made]) -> str:
    return "".join(c.tex for c in children)


def single(tex: str) -> bool:
    """Whether a script can be put to it without braces."""
    return len(tex.strip()) == 1 or re.fullmatch(r"\\[A-Za-z]+ ?|\\math\w+\{\w+\}", tex) is not None


def base(m: Made) -> str:
    return m.tex.strip() if single(m.tex) else f"{{{m.tex.strip()}}}"


def script(mark: str, m: Made) -> str:
    return f"{mark}{{{m.tex.strip()}}}" if m.tex.strip() else ""


def fence(sign: str) -> str:
    return sign.translate(MATH).strip() if sign else "."


def enclosed(opening: str, content: list[Made], closing: str) -> Made:
    """Content between fences, a matrix where it is a table alone."""
    inner = [c for c in content if c.tex.strip()]
    if len(inner) == 1 and inner[0].table is not None and (opening, closing) in MATRICES:
        return Made("mrow", matrix(inner[0].table, MATRICES[opening, closing]), tall=True)
    tex = joined(content).strip()
    if not opening and not closing:
        return Made("mrow", tex, tall=any(c.tall for c in content))
    return Made("mrow", f"\\left{fence(opening)} {tex} \\right{fence(closing)}", tall=any(c.tall for c in content))


def matrix(table: Made, kind: str, columns: str = "") -> str:
    rows = [" & ".join(cell.tex.strip() for cell in row.parts) for row in table.parts]
    return f"\\begin{{{kind}}}{columns}" + " \\\\ ".join(rows) + f"\\end{{{kind}}}"


def group(children: list[Made], attrs: dict[str, str]) -> Made:
    """A row.  Fences at its ends grow with what is between them, a table alone between them is a matrix."""
    inner = [c for c in children if c.tex.strip() or c.sign]
    if len(inner) == 1:
        return inner[0]
    first, last = (inner[0], inner[-1]) if inner else (None, None)
    if first and first.name == "mo" and first.sign in OPENING:
        if last.name == "mo" and last.sign in CLOSING and len(inner) > 2:
            body = inner[1:-1]
            if body[0].table is not None and len(body) == 1 or any(c.tall for c in body):
                return enclosed(first.sign, body, last.sign)
        elif len(inner) == 2 and inner[1].table is not None:
            return enclosed(first.sign, inner[1:], "")
    return Made("mrow", joined(children), tall=any(c.tall for c in children))


def identifier(text: str, attrs: dict[str, str]) -> str:
    variant = attrs.get("mathvariant", "")
    tex = text.translate(MATH)
    if variant in VARIANTS:
        return f"\\{VARIANTS[variant]}{{{tex.strip()}}}"
    if text in FUNCTIONS:
        return f"\\{text} "
    return f"\\mathrm{{{tex.strip()}}}" if (len(text) > 1 and text.isalpha() and text.isascii()) or (variant == "normal" and text.isascii() and text.isalpha()) else tex


def token(name: str, text: str, attrs: dict[str, str]) -> Made:
    text = " ".join(text.translate(INVISIBLE).split())
    if name in ("mtext", "ms"):
        quoted = f"{attrs.get('lquote', chr(34))}{text}{attrs.get('rquote', chr(34))}" if name == "ms" else text
        return Made(name, f"\\text{{{quoted.translate(TEXT)}}}" if quoted else "", text)
    if name == "mi" or text in FUNCTIONS:
        return Made(name, identifier(text, attrs), text)
    return Made(name, text.translate(MATH), text)


def space(attrs: dict[str, str]) -> Made:
    if attrs.get("linebreak") == "newline":
        return Made("mspace", " \\\\ ")
    m = re.fullmatch(r"\s*([0-9.]+)em\s*", attrs.get("width", ""))
    try:
        width = float(m[1]) if m else 0.0
    except ValueError:
        width = 0.0
    return Made("mspace", "\\qquad " if width >= 2 else "\\quad " if width >= 1 else "\\ " if width > 0 else "")


def fraction(children: list[Made], attrs: dict[str, str]) -> Made:
    top, bottom = children
    if attrs.get("bevelled") == "true":
        return Made("mfrac", f"{base(top)}/{base(bottom)}")
    bare = re.fullmatch(r"\s*0+(\.0*)?\s*[a-z%]*\s*", attrs.get("linethickness", ""))
    return Made("mfrac", f"{'{' if bare else chr(92) + 'frac{'}{top.tex.strip()}{' ' + chr(92) + 'atop ' if bare else '}{'}{bottom.tex.strip()}}}", tall=True)


def limits(body: Made, under: Made | None, over: Made | None) -> Made:
    """What stands below and above: limits of a large operator, an accent, a brace or a line, else set over it."""
    if body.tex.strip() in LIMITS or body.tex.strip().startswith("\\int"):
        return Made("munderover", body.tex.strip() + (script("_", under) if under else "") + (script("^", over) if over else ""), tall=True)
    tex, inner = base(body), body.tex.strip()
    if over is not None:
        accent = OVER.get(over.sign) if over.name == "mo" else None
        if accent:
            accent = WIDE.get(accent, accent) if not single(body.tex) else accent
            tex = f"{accent}{{{inner}}}"
        elif over.tex.strip():
            tex = f"{inner}^{{{over.tex.strip()}}}" if inner.startswith("\\overbrace") else f"\\overset{{{over.tex.strip()}}}{{{inner}}}"
    if under is not None:
        line = UNDER.get(under.sign) if under.name == "mo" else None
        if line:
            tex = f"{line}{{{tex if over is not None else inner}}}"
        elif under.tex.strip():
            whole = tex if over is not None else inner
            tex = f"{whole}_{{{under.tex.strip()}}}" if inner.startswith("\\underbrace") else f"\\underset{{{under.tex.strip()}}}{{{whole}}}"
    return Made("munderover", tex, tall=body.tall)


def scripts(children: list[Made], marks: str) -> Made:
    body, *rest = children
    tex = base(body)
    for mark, m in zip(marks, rest, strict=True):
        tex += m.tex.strip() if mark == "^" and m.tex.strip() and set(m.tex.strip()) == {"'"} else script(mark, m)
    return Made("mscript", tex + (" " if re.search(r"\\[A-Za-z]+$", tex) else ""), tall=body.tall)


def multiscripts(children: list[Made]) -> Made:
    body, rest = children[0], children[1:]
    at = next((k for k, c in enumerate(rest) if c.name == "mprescripts"), len(rest))
    put = lambda ms: "".join(script("_^"[k % 2], m) for k, m in enumerate(ms))
    before = put(rest[at + 1 :])
    return Made("mscript", ("{}" + before if before else "") + base(body) + put(rest[:at]))


def fenced(children: list[Made], attrs: dict[str, str]) -> Made:
    opening, closing = attrs.get("open", "(").strip(), attrs.get("close", ")").strip()
    separators = "".join(attrs.get("separators", ",").split())
    content: list[Made] = []
    for k, c in enumerate(children):
        if k and separators:
            content.append(Made("mo", separators[min(k, len(separators)) - 1].translate(MATH)))
        content.append(c)
    return enclosed(opening, content, closing)


def table(children: list[Made], attrs: dict[str, str]) -> Made:
    rows = [c if c.name == "mtr" else Made("mtr", "", parts=(c,)) for c in children]
    out = Made("mtable", "", parts=tuple(rows), tall=True)
    align = [a[0] for a in attrs.get("columnalign", "").split() if a in ("left", "center", "right")]
    if align and set(align) != {"c"}:
        columns = max((len(r.parts) for r in rows), default=1)
        out.tex = matrix(out, "array", "{" + "".join((align + align[-1:] * columns)[:columns]) + "}")
    else:
        out.tex = matrix(out, "matrix")
    out.table = out
    return out


def enclose(children: list[Made], attrs: dict[str, str]) -> Made:
    tex = joined(children).strip()
    for kind in attrs.get("notation", "longdiv").split():
        if kind in ENCLOSED:
            tex = f"{ENCLOSED[kind]}{{{tex}}}"
    return Made("menclose", tex, tall=True)


#: Number of children, and what becomes of them.
Rule = Callable[[list[Made], dict[str, str]], Made]
RULES: dict[str, tuple[int | None, Rule]] = {
    "mfrac": (2, fraction),
    "msqrt": (None, lambda c, a: Made("msqrt", f"\\sqrt{{{group(c, a).tex.strip()}}}", tall=True)),
    "mroot": (2, lambda c, a: Made("mroot", f"\\sqrt[{c[1].tex.strip()}]{{{c[0].tex.strip()}}}", tall=True)),
    "msup": (2, lambda c, a: scripts(c, "^")),
    "msub": (2, lambda c, a: scripts(c, "_")),
    "msubsup": (3, lambda c, a: scripts(c, "_^")),
    "munder": (2, lambda c, a: limits(c[0], c[1], None)),
    "mover": (2, lambda c, a: limits(c[0], None, c[1])),
    "munderover": (3, lambda c, a: limits(*c)),
    "mfenced": (None, fenced),
    "mtable": (None, table),
    "mtr": (None, lambda c, a: Made("mtr", "", parts=tuple(c))),
    "mlabeledtr": (None, lambda c, a: Made("mtr", "", parts=tuple(c[1:]))),
    "menclose": (None, enclose),
    "mphantom": (None, lambda c, a: Made("mphantom", f"\\phantom{{{joined(c).strip()}}}")),
    "semantics": (None, lambda c, a: c[0] if c else Made("mrow", "")),
    "maction": (None, lambda c, a: c[min(len(c), int(a["selection"]) if a.get("selection", "").isdigit() and int(a["selection"]) else 1) - 1] if c else Made("mrow", "")),
    "mspace": (None, lambda c, a: space(a)),
    "annotation": (None, lambda c, a: Made("annotation", "")),
    "annotation-xml": (None, lambda c, a: Made("annotation", "")),
    "mprescripts": (None, lambda c, a: Made("mprescripts", "")),
    "none": (None, lambda c, a: Made("none", "")),
}
TOKENS = frozenset("mi mn mo mtext ms".split())


def convert(el: ET.Element) -> Made:
    if el.tag in TOKENS:
        return token(el.tag, "".join(el.itertext()), el.attrib)
    children = [convert(c) for c in el]
    if el.tag == "mmultiscripts":
        return multiscripts(children) if children else Made("mrow", "")
    n, rule = RULES.get(el.tag, (None, group))
    if n is not None:
        children = [*children[:n], *[Made("none", "")] * (n - len(children))]
    if not len(el) and el.text and el.tag in ("math", "mrow", "mstyle", "mtd"):  # text that stands in no token
        return token("mi" if len(el.text.strip()) == 1 else "mtext", el.text, {})
    return rule(children, el.attrib)


def parse(mathml: str) -> ET.Element:
    """The tree with local names; prefixes need no declaration."""
    text = re.sub(r"&(?!(?:amp|lt|gt|quot|apos);|#)(\w+);", lambda m: html.unescape(m[0]) if html.unescape(m[0]) != m[0] else "", mathml)
    made, depth, parser = ET.TreeBuilder(), 0, expat.ParserCreate()
    local = lambda name: name.rsplit(":", 1)[-1]

    def start(name: str, attrs: dict[str, str]) -> None:
        nonlocal depth
        depth += 1
        if depth > DEEPEST:
            raise ValueError("nested too deep")
        made.start(local(name), {local(k): v for k, v in attrs.items()})

    def end(name: str) -> None:
        nonlocal depth
        depth -= 1
        made.end(local(name))

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, made.data
    parser.Parse(text, True)
    return made.close()


@lru_cache(maxsize=20_000)
def to_latex(mathml: str | None) -> str | None:
    """LaTeX without dollars; null for what isn't MathML or says nothing."""
    try:
        tex = convert(parse(mathml or "")).tex
    except (expat.ExpatError, ValueError):
        return None
    # a command's space is needed before letters alone
    tex = re.sub(r"(\\[A-Za-z]+) (?=[^A-Za-z]|$)", r"\1", re.sub(r"\s+", " ", tex))
    return tex.strip() or None


@F.pandas_udf(StringType())
def mathml_to_latex(mathml: pd.Series) -> pd.Series:
    return mathml.map(to_latex)
