"""Equation binaries made byte by byte, compound files, and input cut short."""

import struct

from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.operators import mtef as M
from quillspark.sources import ole

HEAD = bytes([5, 1, 0, 5, 0]) + b"DSMT\0" + b"\0"


def native(records: bytes) -> bytes:
    body = HEAD + records
    return struct.pack("<HIHI", 28, 0, 0, len(body))[:8] + struct.pack("<I", len(body)) + bytes(16) + body


def char(c: str, face: int = 131) -> bytes:
    return bytes([2, 0, face]) + struct.pack("<H", ord(c))


def line(*xs: bytes) -> bytes:
    return b"\x01\x00" + b"".join(xs) + b"\0"


def template(selector: int, *slots: bytes, variation: int = 0) -> bytes:
    return bytes([3, 0, selector, variation, 0]) + b"".join(slots) + b"\0"


def latex(*xs: bytes) -> str:
    return M.native_to_latex(native(b"\x0a" + line(*xs) + b"\0"))


def test_templates():
    assert latex(char("1")) == "1"
    assert latex(char("x"), template(28, line(), line(char("2")))) == "x ^ { 2 }"
    assert latex(template(11, line(char("a")), line(char("b")))) == r"\frac { a } { b }"
    assert latex(template(10, line(char("a")), line())) == r"\sqrt[] { a }"
    assert latex(template(1, line(char("a")), char("("), char(")"))) == r"\left ( { a } \right )"
    assert latex(template(2, line(char("a")), char("{"))) == r"\left \{ \begin{array}{l} a \end{array} \right."
    assert latex(template(29, line(char("i")), line(char("n")))) == "_{ i }  ^{ n }"
    assert latex(template(16, line(char("k")), line(char("1")), line(char("n")), char("∑"))) == r"∑ \limits_{ 1 } ^ n { k }"
    assert latex(template(14, line(char("a")), line(), variation=0x20)) == r"\xrightarrow  {\mathrm{ a }}"
    assert latex(template(31, line(char("v")), variation=2)) == r"\overset\rightarrow { v }"
    assert latex(template(15, line(char("a")))) == ""
    assert latex(template(11, line(char("a")))) == ""


def test_records():
    assert latex(char("a", 129)) == r"{ \rm{ a } }"
    assert latex(char("%"), char("\x05"), char("<"), char("≤")) == r"\% < ≤"
    assert latex(char("y"), bytes([6, 0, 9, 0])) == r"\hat y"
    assert latex(char("y"), bytes([6, 0, 5, 0])) == "y'"
    assert latex(bytes([4, 0, 1, 1]), line(char("a")), line(), line(char("b")), b"\0") == r"a \\ b"
    cells = b"".join(line(char(c)) for c in "abcd")
    assert latex(bytes([5, 0, 1, 1, 1, 2, 2, 0, 0]) + cells + b"\0") == r"\begin{array}{ll} a & b \\ c & d \end{array}"
    assert latex(bytes([7]), char("a")) == ""
    assert latex(bytes([100, 3, 9, 9, 9]), char("a")) == "a"
    assert M.native_to_latex(native(bytes([18, 0, 2, 0x21, 0x2F]))) == ""


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=200))
def test_never_fails(data):
    assert isinstance(M.native_to_latex(native(data)), str)
    assert isinstance(M.convert_object(data)[1], str)
    assert isinstance(M.convert_object(ole.MAGIC + data)[1], str)


def compound(name: str, content: bytes) -> bytes:
    """A file of one stream in the mini stream."""
    entry = lambda n, kind, start, size, child=0xFFFFFFFF: n.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB3I", 2 * len(n) + 2, kind, 1, 0xFFFFFFFF, 0xFFFFFFFF, child) + bytes(36) + struct.pack("<III", start, size, 0)
    sectors = -(-len(content) // 512)
    minis = -(-len(content) // 64)
    end, free = 0xFFFFFFFE, 0xFFFFFFFF
    fat = [0xFFFFFFFD, end, end, *range(4, 3 + sectors), end]
    mini = [*range(1, minis), end]
    head = ole.MAGIC + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<9I", 0, 1, 1, 0, 4096, 2, 1, end, 0) + struct.pack("<109I", 0, *[free] * 108)
    pad = lambda ws: struct.pack(f"<{len(ws)}I", *ws).ljust(512, b"\xff")
    directory = entry("Root Entry", 5, 3, len(content), 1) + entry(name, 2, 0, len(content))
    return head + pad(fat) + directory.ljust(512, b"\0") + pad(mini) + content.ljust(512 * sectors, b"\0")


def test_compound_file():
    body = native(line(char("x"), char("+"), char("1"))) + bytes(300)
    data = compound("Equation Native", body)
    assert ole.equation_stream(data) == body
    assert M.convert_object(data) == (None, "x+1")
    held = compound("MathML", b"..<math>y</math>..")
    assert M.convert_object(held) == ("<math>y</math>", "y")
    assert M.convert_object(b"zz<math>q</math>") == ("<math>q</math>", "q")
    assert M.convert_object(b"not-an-ole") == (None, M.NO_FORMULA)
    assert M.convert_object(None) == (None, M.NO_FORMULA)


def test_characters_of_the_symbol_fonts():
    """By rule and by table, and those that have neither; other faces keep Unicode."""
    told = {0x2264: "\\le ", 0x2209: "\\notin ", 0x220C: "\\not\\ni ", 0x21D2: "\\Rightarrow ", 0x21B0: "\\Lsh ", 0x2115: "\\mathbb{N}", 0x2128: "\\mathfrak{X}", 0xAA: "{}^\\text{a}", 0x16E: "\\overset{\\circ}{U}", 0x3A3: "\\Sigma ", 0x20A7: "\\peseta ", 0xF104: "\\mathcal{E}", 0xEF22: "\\!", 0x22ED: "\\ntrianglerighteq ", 0x2A0C: "\\iiiint "}
    for code, want in told.items():
        assert M.shown(code, M.EXTRA) == M.shown(code, M.SPACE) == want
        assert M.shown(code, 131) == chr(code)
    for code in (0x219F, 0x2212, 0x3BF, 0x1CD, 0x2C6, 0x41):
        assert M.shown(code, M.EXTRA) == chr(code)
    assert M.shown(0x3A, M.EXTRA) == "\\:" and M.shown(0x2212, 131) == "-"
