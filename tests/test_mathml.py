"""MathML constructs by hand, damage, and MathML in objects."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.operators import mathml as M
from quillspark.operators.mtef import NO_CONVERSION, NO_FORMULA, convert_object
from quillspark.plans.convert_queries import MATHML
from quillspark.sources import ole


@pytest.mark.parametrize(("xml", "want"), MATHML)
def test_constructs(xml, want):
    assert M.to_latex(xml.replace("#", "42")) == (want and want.replace("#", "42"))


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ("<mi>sin</mi><mi>x</mi>", r"\sin x"),
        ("<mi>speed</mi><mo>&#x2061;</mo><mn>2</mn>", r"\mathrm{speed}2"),
        ("<mo>{</mo><mi>x</mi><mo>|</mo><mi>x</mi><mo>&ne;</mo><mn>0</mn><mo>}</mo>", r"\{x|x\ne0\}"),
        ("<mrow><mo>(</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><mo>)</mo></mrow>", r"\left( \frac{1}{2} \right)"),
        ("<msup><mrow><mi>a</mi><mi>b</mi></mrow><mn>2</mn></msup>", "{ab}^{2}"),
        ("<msup><mi>&pi;</mi><mn>2</mn></msup><mo>&isin;</mo><mi>&Copf;</mi>", r"\pi^{2}\in\mathbb{C}"),
        ("<mover><mi>x</mi><mo>^</mo></mover><mover><mrow><mi>x</mi><mi>y</mi></mrow><mo>~</mo></mover>", r"\hat{x}\widetilde{xy}"),
        ("<mover><mo>=</mo><mi>a</mi></mover><munder><mi>x</mi><mo>_</mo></munder>", r"\overset{a}{=}\underline{x}"),
        ("<mtable><mlabeledtr><mtd><mtext>no</mtext></mtd><mtd><mi>x</mi></mtd></mlabeledtr></mtable>", r"\begin{matrix}x\end{matrix}"),
        ("<mfenced><mi>a</mi></mfenced><mfenced separators=''><mi>a</mi><mi>b</mi></mfenced>", r"\left( a \right)\left( ab \right)"),
        ("<maction selection='2'><mi>a</mi><mi>b</mi></maction><maction><mi>c</mi></maction>", "bc"),
        ("<mfrac><mn>1</mn></mfrac><msup><mi>a</mi></msup>", r"\frac{1}{}a"),
        ("<mstyle><mpadded><mi>a</mi></mpadded></mstyle><unknown><mi>b</mi></unknown>", "ab"),
        ("<mn>3</mn><mo>&#xB0;</mo><mo>#</mo><ms>a_b</ms>", r"3^{\circ}\#\text{" + '"' + r"a\_b" + '"}'),
        ("<mo>&int;</mo>", r"\int"),
        ("<msubsup><mo>&int;</mo><mn>0</mn><mn>1</mn></msubsup><mi>f</mi>", r"\int_{0}^{1}f"),
    ],
)
def test_elements(inner, want):
    assert M.to_latex(f"<math>{inner}</math>") == want
    assert M.to_latex(f"<x:math xmlns:y='u'>{inner.replace('</', '</x:').replace('<m', '<x:m').replace('<unknown', '<x:unknown')}</x:math>") == want


def test_no_latex():
    for xml in (None, "", "x", "<math>", "<math><mi>a</mn></math>", "<math/>", "<math><mspace/></math>", "<mi>" * 300 + "</mi>" * 300):
        assert M.to_latex(xml) is None


@given(st.recursive(st.sampled_from(["<mi>x</mi>", "<mo>(</mo>", "<mo>|</mo>", "<none/>", "<mtext/>", "<mspace width='.'/>", "<mprescripts/>"]), lambda inner: st.builds(lambda n, xs: f"<{n}>{''.join(xs)}</{n}>", st.sampled_from([*M.RULES, "mmultiscripts", "mrow", "mtd"]), st.lists(inner, max_size=4)), max_leaves=25))
@settings(max_examples=200, deadline=None)
def test_any_tree_is_converted(xml):
    out = M.to_latex(f"<math>{xml}</math>")
    assert out is None or out.count("{") - out.count(r"\{") == out.count("}") - out.count(r"\}")


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16", "utf-16-le", "utf-16-be"])
def test_objects(encoding):
    from test_mtef import compound

    xml = "<math><mfrac><mi>α</mi><mn>2</mn></mfrac></math>"
    for data in (compound("MathML", xml.encode(encoding)), compound("x MathML y", f"..{xml}..".encode(encoding)), b"abc" + xml.encode(encoding) + b"."):
        assert convert_object(data) == (xml, r"\frac{\alpha}{2}")
    assert convert_object(b"<math><mi></math>") == ("<math><mi></math>", NO_CONVERSION)
    assert convert_object(ole.MAGIC + b"<mat") == (None, NO_FORMULA) == convert_object(None)
