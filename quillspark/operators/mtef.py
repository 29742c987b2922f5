"""Equation binaries (MTEF version 5) to LaTeX.

One pass reads the records into a tree: containers stay open until an end record closes them.  A
second turns the tree into LaTeX by one small function per template.  A template or record that
isn't known makes the whole formula unknown (an empty string).  Reads past the end give zeros, and
every loop is bounded by the input's length.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from html.entities import html5

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..sources import ole
from .mathml import to_latex

# Record types, option bits, template selectors and embellishments of the format.
LINE, CHAR, TMPL, PILE, MATRIX, EMBELL = 1, 2, 3, 4, 5, 6
FONT_STYLE, SIZE, FULL, SUB, SUB2, SYM, SUBSYM, COLOR, COLOR_DEF, FONT_DEF, PREFS, ENCODING, FUTURE = 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 100
NUDGE, NULL_LINE, RULER, LINE_SPACE, NO_CODE, CHAR8, CHAR16, CMYK, NAMED = 8, 1, 2, 4, 0x20, 4, 0x10, 1, 4
TEXT, EXTRA, SPACE = 128 + 1, 128 + 11, 128 + 24
MARKS = {2: r" \dot ", 5: "'", 6: "''", 9: r" \hat ", 17: r" \bar ", 18: "'''"}
BEFORE = {2, 9, 17}
# Characters that aren't themselves, by code; some only in the symbol and space fonts.
CHARACTERS = {
    0x22: "''", 0x3C: " < ", 0x3BF: "o", 0x2044: "/", 0x210A: "g", 0x2212: "-", 0x2215: "/", 0x2217: "*", 0x2329: "\\langle ", 0x232A: "\\rangle ",
    0xED10: " d ", 0xED11: " e ", 0xED12: " i ", 0xED13: " j ", 0xED16: " D ", 0xEF01: "", 0x200B: "", 0xEC07: "|", 0xEC08: "|", 0x302: "\\widehat ", 0x86E0: "\\prime ",
}
PLAIN = frozenset(" !()*+,-./0123456789:;=?ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
ESCAPED = frozenset("!#$%&:;_{|}")
# Accents by their combining mark, alphabets by their first code and by the word in a character's name.
ACCENTS = {0x300: "grave", 0x301: "acute", 0x302: "hat", 0x303: "tilde", 0x304: "bar", 0x306: "breve", 0x307: "dot", 0x308: "ddot", 0x30C: "check"}
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ALPHABETS = {0xF000: ("mathfrak", LETTERS), 0xF080: ("mathbb", LETTERS[:26]), 0xF100: ("mathcal", LETTERS[:26])}
STYLES = {"DOUBLE-STRUCK": "mathbb", "SCRIPT": "mathcal", "BLACK-LETTER": "mathfrak"}
# Commands of the symbol and space fonts that no rule below gives, by code.
COMMANDS = """
26 And 5c backslash a7 S ab ll ac neg b1 pm b5 mu b6 P b7 cdot bb gg d7 times d8 O f0 eth f7 div 127 hbar 131 imath
3b5 varepsilon 3c2 varsigma 3c6 varphi 3d1 vartheta 3d2 Upsilon 3d5 phi 3d6 varpi 3db varsigma 3dc digamma 3f0 varkappa 3f1 varrho 3f5 epsilon 3f6 backepsilon
2026 ldots 20a1 Colon 20a2 cruzeiro 20a3 franc 20a4 lira 20a5 mill 20a6 naira 20a7 peseta 20a8 rupee 20a9 won 20aa newsheqel 20ab dong 20ac euro 20ad kip 20ae tugrik
20af drachma 20b0 germanpenny 20b1 peso 20b2 guarani 20b3 austral 20b4 hryvnia 20b5 cedi
2107 gamma 210f hbar 2111 Im 2113 ell 2118 wp 211c Re 2126 Omega 2127 mho 2132 Finv 2135 aleph 2136 beth 2137 gimel 2138 daleth 2192 to 21b0 Lsh 21b1 Rsh 21dd rightsquigarrow
2202 partial 2203 exists 2206 Delta 2208 in 2209 notin 220b ni 220e blacksquare 220f prod 2210 coprod 2213 mp 2216 setminus 2218 circ 2219 bullet 221a surd 221d propto 221e infty 221f perp
2222 sphericalangle 2223 mid 2224 nmid 2225 parallel 2226 nparallel 222b int 222c iint 222e oint 223c sim 2240 wr 2248 approx 224d asymp 2250 doteq 2261 equiv 2264 le 2265 ge
2270 nleqslant 2271 ngeqslant 227a prec 227b succ 2283 supset 2298 oslash 22a1 boxdot 22a5 bot 22a6 vdash 22a8 vDash 22ad nvDash 22b2 triangleleft 22b3 triangleright 22bc barwedge 22bd veebar
22c2 bigcap 22c5 cdot 22c6 star 22d8 lll 22dc eqslantless 22dd eqslantgtr 22e0 npreceq 22e1 nsucceq 22ee vdots 22ef cdots 22f1 ddots 2300 varnothing 2322 frown 2323 smile 2329 langle 232a rangle
2423 textvisiblespace 24c8 circledS 25a0 blacksquare 25b2 blacktriangle 25b3 vartriangle 25b6 blacktriangleright 25bc blacktriangledown 25bd triangledown 25c0 blacktriangleleft 25cb bigcirc
2661 heartsuit 2662 diamondsuit 2666 blacklozenge 2713 checkmark 2715 times 29eb blacklozenge 3008 langle 3009 rangle
e90b supseteqq e90c subseteqq e922 lesseqqgtr e92d gtreqqless e92e shortmid e92f shortparallel e930 leqslant e931 geqslant e932 lessapprox e933 gtrapprox e938 preceq e939 succeq e93a precapprox
e93b succapprox e981 circleddash e98f centerdot ea06 nleq ea07 ngeq ea0b nsupseteqq ea0c nsubseteqq ea11 nsim ea2e nshortmid ea2f nshortparallel ea32 lnapprox ea33 gnapprox ea34 lneq ea35 gneq
ea38 npreceq ea39 nsucceq ea3a precnapprox ea3b succnapprox ea40 precneqq ea41 succneqq ea42 varsubsetneq ea43 varsupsetneq ea44 subsetneqq ea45 supsetneqq ea46 varsubsetneqq ea47 varsupsetneqq
ed01 Game ed02 jmath 2003 quad ef05 quad ef06 qquad f0a4 Bbbk
""".split()
COMMANDS = {int(code, 16): f"\\{name} " for code, name in zip(COMMANDS[::2], COMMANDS[1::2], strict=True)}
# Characters of these fonts that are more than one command, by code.
COMPOSED = {
    0x23: "\\@#", 0x24: "\\$", 0x25: "%", 0x27: "'", 0x3C: " < ", 0x3E: ">", 0x5B: "[", 0x5D: "]", 0x5E: "\\hat{\\ }", 0x5F: "\\_", 0x60: "\\grave{\\ }", 0x7B: "\\{", 0x7C: "|", 0x7D: "\\}", 0x7E: "\\tilde{\\ }", 0xA0: "~",
    0xA1: "\\text{\ufffd}", 0xA2: "\\text{\ufffd}", 0xA3: "\\text{\ufffd}", 0xA4: "\\text{\ufffd}", 0xA5: "\\text{\ufffd}", 0xA6: "\\text{\ufffd}", 0xA8: "\\ddot{\\ }", 0xAF: "\\bar{\\ }", 0xB0: "{}^\\circ ", 0xB4: "\\acute{\\ }",
    0xBC: "{\\scriptscriptstyle 1\\!/\\!{ }_4}", 0xBD: "{\\scriptscriptstyle 1\\!/\\!{ }_2}", 0xBE: "{\\scriptscriptstyle 3\\!/\\!{ }_4}", 0xC5: "{\\AA}", 0x13F: "\\mathrm{L}\\!\\!\\cdot", 0x140: "\\mathrm{l}\\cdot",
    0x16E: "\\overset{\\circ}{U}", 0x16F: "\\overset{\\circ}{u}", 0x39F: "{\\mathrm O}", 0x2016: "\\|", 0x2033: "\\prime\\prime ", 0x2034: "\\prime\\prime\\prime ", 0x2036: "\\backprime\\backprime ", 0x2037: "\\backprime\\backprime\\backprime ",
    0x203E: "\\bar{\\ }", 0x203F: "{}_\\smile ", 0x2040: "{}^\\frown ", 0x210E: "h", 0x2128: "\\mathfrak{X}", 0x21C5: "\\uparrow\\!\\downarrow ", 0x21E4: "\\shortmid\\!\\leftarrow ", 0x21E5: "\\shortmid\\!\\rightarrow ",
    0x220D: "\\backepsilon  ", 0x221B: "\\sqrt[3]{ } ", 0x221C: "\\sqrt[4]{ } ", 0x222F: "\\mathop{{\\int\\!\\!\\!\\!\\!\\int}\\!\\!\\!\\!\\!\\!\\!\\bigcirc}", 0x2230: "\\mathop{{\\int\\!\\!\\!\\!\\!\\int\\!\\!\\!\\!\\!\\int}\\!\\!\\!\\!\\!\\!\\!\\!\\!\\bigcirc}",
    0x2231: "\\mathop{\\int\\!\\!\\!\\!\\!\\!\\!\\curvearrowright}", 0x2232: "\\mathop{\\int\\!\\!\\!\\!\\!\\!\\!\\circlearrowright}", 0x2233: "\\mathop{\\int\\!\\!\\!\\!\\!\\!\\!\\circlearrowleft}",
    0x2236: "\\,\\!:", 0x2237: "\\,\\!:\\,:", 0x2238: "\\dot-", 0x2239: "\\,-\\!:", 0x223A: ":\\!\\!\\!-\\!\\!\\!:", 0x223B: "\\sim\\!\\!\\!:\\,", 0x2254: ":=\\,\\!", 0x2255: "=:\\,\\!",
    0x2258: "\\overset{\\frown}{=}", 0x2259: "\\overset{\\wedge}{=}", 0x225A: "\\overset{\\vee}{=}", 0x225B: "\\overset{\\star}{=}", 0x225D: "\\overset{\\underset{\\mathrm{def}}{}}{=}", 0x225E: "\\overset{\\underset{\\mathrm{m}}{}}{=}", 0x225F: "\\overset{?}{=}",
    0x229C: "\\,\\bigcirc\\!\\!\\!\\!\\!\\!\\!=", 0x22AB: "\\,\\|\\!\\!\\!=", 0x2353: "\\Box\\!\\!\\!\\!\\wedge", 0x2370: "\\Box\\!\\!\\!\\!?", 0x27E6: "[\\![", 0x27E7: "]\\!]", 0x29F8: "\\Big /", 0x29F9: "\\Big\\backslash ", 0x301A: "[\\![", 0x301B: "]\\!]",
    0xEA0E: "\\not\\eqslantgtr ", 0xEA0F: "\\not\\eqsim ", 0xEA10: "\\not\\eqslantless ", 0xEB01: "\\overrightarrow{\\scriptscriptstyle\\leftarrow}", 0xEB02: "\\stackrel{\\scriptscriptstyle\\to}{\\leftarrow}",
    0xEF00: " & ", 0xEF02: "\\,", 0x2009: "\\,", 0xEF03: "\\;", 0x205F: "\\;", 0xEF04: "\\ ", 0x2004: "\\ ", 0xEF22: "\\!",
}
# Ranges whose characters are called as the HTML standard calls them, and those of them that stay themselves.
NAMED_RANGES = [(0x2020, 0x2022), (0x2032, 0x2035), (0x2190, 0x21DB), (0x2200, 0x22ED), (0x2306, 0x230B), (0x231C, 0x231F), (0x25A1, 0x25A1), (0x25CA, 0x25CA), (0x2605, 0x2605), (0x2660, 0x2663), (0x266D, 0x266F), (0x27E8, 0x27E9), (0x27F5, 0x27FC), (0x2A00, 0x2A0C)]
UNNAMED = frozenset(int(x, 16) for x in (
    "219f 21a1 21a4 21a5 21a7 21b2 21b3 21b5 2212 2217 223e 223f 2244 2246 224b 224c 228d 22b0 22b6 22b7 22b9 22be 22bf 22cd 22d5 22e2 22e3"
).split())
#: Negated relations that are written as such.
NEGATED = frozenset((0x220C, 0x2249, 0x2262, 0x226D, 0x2274, 0x2275, 0x2278, 0x2279, 0x2284, 0x2285))


@dataclass
class Node:
    kind: int
    value: int = 0
    variation: int = 0
    text: str = ""
    children: list[Node] = field(default_factory=list)


class Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1] if self.at <= len(self.data) else 0

    def skip(self, n: int) -> None:
        self.at += n

    def word(self) -> int:
        return self.byte() | self.byte() << 8

    def string(self) -> None:
        end = self.data.find(b"\0", self.at)
        self.at = len(self.data) if end < 0 else end + 1

    def nudge(self, options: int) -> None:
        if options & NUDGE:
            if 128 in (self.word(), self.word()):
                self.at += 4

    @property
    def over(self) -> bool:
        return self.at >= len(self.data)


def _dimensions(r: Reader) -> None:
    """Nibble-packed numbers, each ended by 15 after a unit; as many as announced or the input holds."""
    left, unit = r.byte(), True
    while left > 0 and not r.over:
        b = r.byte()
        for nibble in (b >> 4, b & 15):
            if unit:
                unit = nibble > 4
            elif nibble == 15:
                unit, left = True, left - 1


def _preferences(r: Reader) -> None:
    r.byte()
    _dimensions(r)
    _dimensions(r)
    for _ in range(r.byte()):
        if r.byte():
            r.byte()


def _character(r: Reader) -> Node:
    options = r.byte()
    r.nudge(options)
    face = r.byte()
    code = 0 if options & NO_CODE else r.word()
    low = r.byte() if options & CHAR8 else 0
    wide = r.word() if options & CHAR16 else 0
    return Node(CHAR, text=shown(code or wide or low, face))


@lru_cache
def named() -> dict[int, str]:
    """Commands that the HTML standard's names give: of a character's names the longest that looks like one of TeX."""
    names: dict[int, str] = {}
    for name, char in html5.items():
        code = ord(char) if len(char) == 1 else -1
        if re.fullmatch(r"(?:[A-Z]?[a-z]+|n?[VL]?[VD]?[dR]?[a-z]+);", name) and any(a <= code <= b for a, b in NAMED_RANGES) and code not in UNNAMED:
            names[code] = max(names.get(code, ""), name[:-1], key=lambda n: (len(n), n))
    return {code: f"\\{name} " for code, name in names.items()}


@lru_cache(maxsize=4096)
def special(code: int) -> str | None:
    """A character of the symbol and space fonts: its table entry, or by rule an accented, Greek, raised or styled letter, a negation, or a standard name."""
    if code in COMMANDS or code in COMPOSED:
        return COMMANDS.get(code) or COMPOSED.get(code)
    for first, (command, letters) in ALPHABETS.items():
        if first <= code < first + len(letters):
            return f"\\{command}{{{letters[code - first]}}}"
    parts = unicodedata.normalize("NFD", chr(code))
    if code <= 0x17E and len(parts) == 2 and parts[0] in LETTERS and ord(parts[1]) in ACCENTS:
        return f"\\{ACCENTS[ord(parts[1])]}{{{parts[0]}}}"
    if code in NEGATED:
        return f"\\not{special(ord(parts[0]))}"
    raised = unicodedata.decomposition(chr(code))
    if code < 0x100 and raised.startswith("<super>") and len(raised.split()) == 2:
        return f"{{}}^\\text{{{chr(int(raised.split()[1], 16))}}}"
    told = unicodedata.name(chr(code), "")
    greek = re.fullmatch("GREEK (SMALL|CAPITAL) LETTER ([A-Z]+)", told)
    if greek and 0x391 <= code <= 0x3C9 and code != 0x3BF:
        name = greek[2].replace("LAMDA", "LAMBDA")
        return f"\\{name.capitalize() if greek[1] == 'CAPITAL' else name.lower()} "
    styled = re.fullmatch("(DOUBLE-STRUCK|SCRIPT|BLACK-LETTER) CAPITAL ([A-Z])", told)
    if styled and code <= 0x2133:
        return f"\\{STYLES[styled[1]]}{{{styled[2]}}}"
    return named().get(code)


def shown(code: int, face: int) -> str:
    """A character's LaTeX: its table entry, an escape, or itself; control characters vanish."""
    own = special(code) if face in (EXTRA, SPACE) else CHARACTERS.get(code, chr(code) if chr(code) in PLAIN else None)
    if code == 0 or (own is None and code < 32 and code not in (9, 10, 13)):
        return ""
    text = own if own else chr(code)
    if not own and text in ESCAPED:
        text = "\\" + text
    return rf"{{ \rm{{ {text} }} }}" if face == TEXT else text


def _line(r: Reader) -> Node:
    options = r.byte()
    r.nudge(options)
    if options & LINE_SPACE:
        r.byte()
    if options & RULER:
        r.skip(3 * r.byte())
    return Node(LINE, value=options & NULL_LINE)


def _template(r: Reader) -> Node:
    r.nudge(r.byte())
    selector, low = r.byte(), r.byte()
    variation = (low & 0x7F) | r.byte() << 8 if low & 0x80 else low
    r.byte()
    return Node(TMPL, selector, variation)


def _pile(r: Reader) -> Node:
    r.nudge(r.byte())
    r.at += 2
    return Node(PILE)


def _matrix(r: Reader) -> Node:
    r.nudge(r.byte())
    r.at += 4  # three alignments and the number of rows
    return Node(MATRIX, variation=r.byte())


def _embellishment(r: Reader) -> Node:
    r.nudge(r.byte())
    return Node(EMBELL, r.byte())


def _color(r: Reader) -> None:
    options = r.byte()
    r.at += 8 if options & CMYK else 6
    if options & NAMED:
        r.string()


def _indexed_name(r: Reader) -> None:
    r.byte()
    r.string()


READ: dict[int, Callable[[Reader], Node | None]] = {
    LINE: _line, CHAR: _character, TMPL: _template, PILE: _pile, MATRIX: _matrix, EMBELL: _embellishment, FONT_STYLE: _indexed_name, FONT_DEF: _indexed_name,
    SIZE: lambda r: (r.word(), None)[1], COLOR: lambda r: (r.byte(), None)[1], COLOR_DEF: _color, PREFS: _preferences, ENCODING: lambda r: r.string(),
    **dict.fromkeys((FULL, SUB, SUB2, SYM, SUBSYM), lambda r: None),
}


def tree(body: bytes) -> Node | None:
    """The records as a tree, or None if one isn't known."""
    r = Reader(body)
    r.at = 5
    r.string()
    r.byte()
    root = Node(255)
    stack = [root]
    while not r.over:
        kind = r.byte()
        if kind >= FUTURE:
            r.skip(r.byte())
            continue
        if kind == 0:
            if len(stack) > 1:
                stack.pop()
            continue
        if kind not in READ:
            return None
        node = READ[kind](r)
        if node is None:
            continue
        siblings = stack[-1].children
        siblings.append(node)
        if kind == EMBELL and node.value in BEFORE and len(siblings) > 1:
            siblings[-2:] = [node, siblings[-2]]
        if kind != CHAR and not (kind == LINE and node.value):
            stack.append(node)
        if kind == MATRIX:  # its two partition bytes close two lines that open here
            outer, inner = Node(LINE), Node(LINE)
            node.children.append(outer)
            outer.children.append(inner)
            stack += [outer, inner]
    return root


class Unknown(Exception):
    pass


def _fence(main: str, left: str, right: str, *_) -> str:
    return " ".join(["\\left " + left if left else "", f"{{ {main} }}" if main else "", "\\right " + right if right else ""])


def _scripts(low: str, high: str, *_) -> str:
    return (f"_{{ {low} }}" if low else "") + "  " + (f"^{{ {high} }}" if high else "")


def _arrow(variation: int, top: str, bottom: str, *_) -> str:
    heads = [w for bit, w in ((0x10, "leftarrow"), (0x20, "rightarrow")) if variation & bit] if not variation & 3 else []
    return " ".join(["\\x" + "".join(heads), rf"[\mathrm{{ {bottom} }}]" if bottom else "", rf"{{\mathrm{{ {top} }}}}" if top else ""])


def _vector(variation: int, main: str, *_) -> str:
    names = "".join(w for bit, w in ((1, "left"), (2, "right"), (4, "tvVE_UNDER"), (8, "harpoonup")) if variation & bit)
    return "\\overset\\" + names + ("arrow" if variation < 8 else "") + " " + (f"{{ {main} }}" if main else "")


def _sum(main: str, low: str, high: str, sign: str) -> str:
    return " ".join([sign, rf"\limits_{{ {low} }}" if low else "", f"^ {high}" if high else "", f"{{ {main} }}" if main else ""])


#: selector -> (least number of slots, function of variation and four slots)
TEMPLATES: dict[int, tuple[int, Callable[..., str]]] = {
    **dict.fromkeys((0, 1, 9), (3, lambda v, *s: _fence(*s))),
    2: (0, lambda v, m, a, b, *_: rf"\left {a} \begin{{array}}{{l}} {m} \end{{array}} \right{' ' + b if b else '.'}"),
    3: (3, lambda v, m, a, b, *_: rf"\left{a} {m or chr(92) + 'space'} \right{b}"),
    4: (0, lambda v, m, a, b, *_: _fence(m, a, " " + b if b else ".")),
    10: (2, lambda v, m, i, *_: rf"\sqrt[{i}] {{ {m} }}"),
    11: (2, lambda v, n, d, *_: rf"\frac {{ {n} }} {{ {d} }}"),
    12: (1, lambda v, m, *_: " " + (rf" {{\underline{{ {m} }}}} " if m else "") + " "),
    14: (2, _arrow),
    16: (0, lambda v, *s: _sum(*s)),
    23: (0, lambda v, m, low, *_: " ".join([rf"\mathop {{ {m} }}" if m else "", rf"\limits_{{ {low} }}" if low else "", ""])),
    28: (2, lambda v, low, high, *_: f" ^ {{ {high} }} " + (f" {{ {low} }} " if low else "")),
    **dict.fromkeys((27, 29), (2, lambda v, *s: _scripts(*s))),
    31: (1, _vector),
    33: (2, lambda v, m, t, *_: " ".join([f" {t} " if t else "", f"{{ {m} }}" if m else ""])),
    34: (2, lambda v, m, t, *_: " ".join([rf"\overset {t}" if t else "", f"{{ {m} }}" if m else ""])),
}


def _blank(n: Node) -> bool:
    return n.kind == LINE and all(map(_blank, n.children))


def render(n: Node) -> str:
    if n.kind == CHAR:
        return n.text
    if n.kind == EMBELL:
        return MARKS.get(n.value, "")
    parts = [render(c) for c in n.children]
    if n.kind == TMPL:
        least, make = TEMPLATES.get(n.value, (0, None))
        if make is None or len(parts) < least:
            raise Unknown
        # what follows the last named slot counts as that slot again
        return make(n.variation, *(parts + [""] * 4)[:3], parts[-1] if len(parts) > 3 else "")
    if n.kind == PILE:
        return r" \\ ".join(p for p in parts if p.strip())
    if n.kind == MATRIX:
        width = n.variation or 1
        cells = parts[1:] if n.children and _blank(n.children[0]) else parts
        rows = [" & ".join(cells[k : k + width]) for k in range(0, len(cells), width)]
        return rf" \begin{{array}}{{{'l' * width}}} " + r" \\ ".join(rows) + r" \end{array} "
    return "".join(parts)


def body_of(native: bytes) -> bytes:
    """The records behind the 28-byte header, whose stated size is held to what is there."""
    if len(native) < 28:
        raise ValueError("too short")
    header = struct.unpack_from("<H", native)[0]
    header = header if header == 28 else struct.unpack_from("<I", native)[0]
    if not 12 <= header <= len(native):
        raise ValueError("no header")
    size = struct.unpack_from("<I", native, 8)[0]
    return native[header : header + size] if 0 < size <= len(native) - header else native[header:]


def native_to_latex(native: bytes | None) -> str:
    """LaTeX without dollars; empty for what can't be decoded."""
    try:
        root = tree(body_of(native or b""))
        return "" if root is None else render(root).strip()
    except (Unknown, ValueError):
        return ""


NO_FORMULA, NO_CONVERSION = "【无法提取】", "【MathML转LaTeX失败】"


def convert_object(data: bytes | None) -> tuple[str | None, str]:
    """``(mathml, latex)`` of an embedded object: its equation, else its MathML converted; never fails, marks say what was not possible."""
    held = ole.mathml(data)
    try:
        latex = native_to_latex(ole.equation_stream(data or b"") or b"")
    except (ValueError, struct.error, IndexError):
        latex = ""
    return held, latex or ((to_latex(held) or NO_CONVERSION) if held else NO_FORMULA)


@F.pandas_udf(StringType())
def mtef_to_latex(native: pd.Series) -> pd.Series:
    return native.map(native_to_latex)


@F.pandas_udf(StructType([StructField("mathml", StringType()), StructField("latex", StringType())]))
def ole_formula(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([convert_object(d) for d in data], columns=["mathml", "latex"])
