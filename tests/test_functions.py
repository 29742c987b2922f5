"""Goldens by hand from the rules, and properties."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import latex as X
from quillspark.functions import markdown as M
from quillspark.operators import omml
from quillspark.operators.clean import clean_document, preprocess_document
from quillspark.sources.docx import NS


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_strip_is_its_pattern(spark):
    """The sets of characters are those of the patterns, at both ends and in texts of white space alone."""
    from quillspark.functions import regex as R

    chars = spark.range(1, 0x10000).where("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    texts = chars.select(F.explode(F.array("c", F.concat("c", "c"), F.concat("c", F.lit(" a"), "c", F.lit("b\n"), "c"))).alias("t"))
    for space in (R.PY_SPACE, R.JS_SPACE):
        assert texts.where(R.strip(F.col("t"), space) != F.regexp_replace("t", rf"\A[{space}]+|[{space}]+\z", "")).count() == 0
    assert value(spark, R.strip, "") == "" and value(spark, R.strip, None) is None


def test_strip_looks_at_ends(spark):
    """No pattern is tried at every character of a text."""
    from quillspark.functions import regex as R

    plan = spark.createDataFrame([("a",)], "t string").select(R.strip(F.col("t")))._jdf.queryExecution().toString()
    assert "regexp_replace" not in plan


def test_postprocess_goldens(spark):
    assert value(spark, M.postprocess, "# 标题\n\n\n\n段落  \n") == "# 标题\n\n段落\n"
    assert value(spark, M.postprocess, "#x\ny\r\nC# z\nw") == "# x\n\ny\nC# z\n\nw\n"
    assert value(spark, M.postprocess, "a\n\n$$\n\nx\n\n$$\nb") == "a\n$$\nx\n$$\nb\n"


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="#$![]() \n\r\tab.\\1", max_size=60), min_size=5, max_size=20))
def test_postprocess_ends_once(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(M.postprocess(F.col("t")).alias("x")).collect()
    assert all(r["x"].endswith("\n") and not r["x"].endswith("\n\n") for r in rows)


def test_xml_safe(spark):
    assert value(spark, X.xml_safe, "a\x00b\x01c\x1fd") == "abcd"
    assert value(spark, X.xml_safe, None) == ""


def test_html_traps(spark):
    assert value(spark, M.html_to_markdown, "<pre>x</pre>") == "\n\nx"
    assert value(spark, M.html_to_markdown, "&amp;lt; &lt;") == "&lt; <"
    assert value(spark, M.html_to_markdown, "<h2><b>T</b> </h2>") == "\n\n## T\n\n"
    assert value(spark, M.html_to_markdown, None) is None


def test_omml():
    m = lambda x: omml.to_latex(f'<m:oMath xmlns:m="{NS["m"]}">{x}</m:oMath>')
    r = lambda x: f"<m:r><m:t>{x}</m:t></m:r>"
    assert m(f"<m:f><m:num>{r('a')}</m:num><m:den>{r('b')}</m:den></m:f>") == r"\dfrac{a}{b}"
    assert m(f"<m:f><m:num>{r('a')}</m:num></m:f>") == r"\dfrac{a}{}"
    assert m(f"<m:d><m:e>{r('a')}</m:e><m:e>{r('b')}</m:e></m:d>") == r"\left(a,b\right)"
    assert m(f"<m:nary><m:e>{r('x')}</m:e></m:nary>") == r"\sum _{}^{}{x}"
    assert m("<m:r><m:t>a</m:t><m:t>b</m:t></m:r>") == "a"
    assert m("<m:strange>5%</m:strange>") == r"5\%"
    assert omml.to_latex("<broken") is None


def test_cleaning():
    w = lambda x: f'<w:body xmlns:w="{NS["w"]}" xmlns:wp="{NS["wp"]}">{x}</w:body>'
    assert "anchor" not in clean_document(w("<w:p><w:r><wp:anchor/></w:r></w:p>"))
    assert clean_document(w("<w:tc><w:p/></w:tc>")).count("p />") == 1
    assert ">ab<" in clean_document(w("<w:p><w:ins><w:ins><w:r><w:t>ab</w:t></w:r></w:ins></w:ins></w:p>"))
    xml, tabs, blank = preprocess_document(w("<w:tc><w:p/><w:p/></w:tc><w:p><w:r><w:drawing/></w:r></w:p><w:tab/>"))
    assert (tabs, blank) == (1, 1) and "drawing" in xml
    assert clean_document("<w:broken") == "<w:broken"
