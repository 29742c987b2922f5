"""Formulas replaced in the bytes of a part: everything else stays, whatever the prefixes, encoding and nesting."""

import pytest

from quillspark.operators import formula_runs as R
from quillspark.sources.docx import NS, Package, zipped

W, M, O = NS["w"], NS["m"], NS["o"]  # noqa: E741
R_OPEN = '<w:r><w:t xml:space="preserve">'


def doc(inner, names=f'xmlns:w="{W}" xmlns:m="{M}" xmlns:o="{O}"'):
    return f"<?xml version='1.0'?>\n<!-- c --><w:document {names}><w:body>{inner}</w:body></w:document>".encode()


MATH = "<m:oMath><m:r><m:t>{}</m:t></m:r></m:oMath>"


@pytest.mark.parametrize(
    ("inner", "marked", "latex"),
    [
        ("<w:p a='>' />x", "<w:p a='>' />x", "<w:p a='>' />x"),
        (f"<w:p>{MATH.format('a')}</w:p><m:oMathPara z='>'>{MATH.format('b')}</m:oMathPara>", f"<w:p>{R_OPEN}⟦MT:002⟧</w:t></w:r></w:p>{R_OPEN}⟦MT:001⟧</w:t></w:r>", f"<w:p>{R_OPEN}$a$</w:t></w:r></w:p>{R_OPEN}$$b$$</w:t></w:r>"),
        ("<m:oMath/>é<m:oMath a='/>'></m:oMath>", f"{R_OPEN}⟦MT:001⟧</w:t></w:r>é{R_OPEN}⟦MT:002⟧</w:t></w:r>", "é"),
        ("<w:object><o:OLEObject ProgID='Equation.3'/></w:object><w:object><o:OLEObject ProgID='Excel'/></w:object>", f"{R_OPEN}⟦MT:001⟧</w:t></w:r><w:object><o:OLEObject ProgID='Excel'/></w:object>", "<w:object><o:OLEObject ProgID='Equation.3'/></w:object><w:object><o:OLEObject ProgID='Excel'/></w:object>"),
        (f"<m:oMathPara>{MATH.format('<![CDATA[<]]>')}<w:object><o:OLEObject ProgID='Equation.3'/></w:object></m:oMathPara>", f"{R_OPEN}⟦MT:001⟧</w:t></w:r>", f"{R_OPEN}$$&lt;$$</w:t></w:r>"),
    ],
)
def test_bytes(inner, marked, latex):
    head, tail = doc("@").decode().split("@")
    assert R.rewritten(doc(inner), R.marked, True)[0].decode() == head + marked + tail
    assert R.rewritten(doc(inner), R.inlined, False)[0].decode() == head + latex + tail


def test_prefixes_and_encodings():
    other = f'<d:document xmlns:d="{W}"><d:p><q:oMath xmlns:q="{M}"><q:r><q:t>a</q:t></q:r></q:oMath></d:p></d:document>'.encode()
    assert R.rewritten(other, R.inlined, False)[0] == f'<d:document xmlns:d="{W}"><d:p><d:r><d:t xml:space="preserve">$a$</d:t></d:r></d:p></d:document>'.encode()
    plain = f'<oMath xmlns="{M}"><r><t>π</t></r></oMath>'.encode()
    out, rows = R.rewritten(plain, R.inlined, False)
    assert out == f'<w:r xmlns:w="{W}"><w:t xml:space="preserve">$\\pi$</w:t></w:r>'.encode() and rows[0]["latex"] == "\\pi"
    wide = doc(MATH.format("é")).decode().replace("version='1.0'", "version='1.0' encoding='UTF-16'").encode("utf-16")
    assert "$é$" in R.rewritten(wide, R.inlined, False)[0].decode()


def test_damage_changes_nothing(spark):
    for xml in (None, b"", b"<w:p>", b"<m:oMath/>", doc("<a></b>"), b"\xff\xfe\x00"):
        assert R.rewritten(xml, R.marked, True) == (None, [])
    broken, none = zipped([(R.BODY, b"<x"), ("a", b"1")]), zipped([("a", b"1")])
    good = zipped([("a/b.bin", bytes(range(256))), (R.BODY, doc(MATH.format("a")))])
    rows = {r["doc_id"]: r for r in R.with_marks(spark.createDataFrame([("b", broken), ("n", none), ("z", b"no"), ("o", None), ("g", good)], "doc_id string, content binary")).collect()}
    assert [bytes(rows[k]["content"]) for k in "bnz"] == [broken, none, b"no"] and rows["o"]["content"] is None
    made = Package(bytes(rows["g"]["content"]))
    assert made.read("a/b.bin") == bytes(range(256)) and list(made.items) == ["a/b.bin", R.BODY] and rows["g"]["formulas"][0]["latex"] == "a"
