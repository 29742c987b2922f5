"""Whole conversions and equation binaries built from table columns."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mtef as E
from ..operators import pictures as P
from ..operators import vector_pictures as V
from ..operators.mathml import mathml_to_latex
from ..sources import docx as D
from ..sources.tables import FILES, ROWS, TEXTS, spread, table
from . import convert
from .docx_queries import body, files, sample, when

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda *xs: F.concat(F.lit("<w:p><w:r><w:t xml:space='preserve'>"), *(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs), F.lit("</w:t></w:r></w:p>"))
    doc = body(
        "<w:p><w:pPr><w:pStyle w:val='Heading2'/></w:pPr><w:r><w:t>", F.col("s_name"), "</w:t></w:r></w:p>", p("1. first ", F.col("s_suppkey")), p("【答案】A"), p("2、second"),
        "<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t xml:space='preserve'> a&lt;b </w:t></w:r><m:oMath><m:sSup><m:e><m:r><m:t>x</m:t></m:r></m:e><m:sup><m:r><m:t>2</m:t></m:r></m:sup></m:sSup></m:oMath>",
        "<w:hyperlink r:id='r1'><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>h</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc>", p("c"), "</w:tc></w:tr></w:tbl>",
    )
    rels = f'<Relationships xmlns="{D.NS["rel"]}"><Relationship Id="r1" Target="http://a.b/c"/></Relationships>'
    return files(table(spark, sf_dir, "supplier"), "s_suppkey", {"word/document.xml": doc, "word/_rels/document.xml.rels": rels, "word/embeddings/oleObject1.bin": "not-an-ole", "word/embeddings/oleObject2.bin": F.when(F.col("s_suppkey") % 3 == 0, "..<math><mi>q</math>..").otherwise(F.concat(F.lit("..<math><mfrac><mi>q</mi><mn>"), F.col("s_suppkey").cast("string"), F.lit("</mn></mfrac></math>..")))})


def _pictured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures, an equation object and its preview, a formula and a typed link, each in some of the files."""
    k = F.col("s_suppkey")
    para = lambda x: f"<w:p><w:r>{x}</w:r></w:p>"
    shape = "<w:object><v:shape style='width:30pt;height:12pt'><v:imagedata r:id='r3'/></v:shape><o:OLEObject ProgID='Equation.DSMT4' r:id='r4'/></w:object>"
    doc = body(
        "<w:p><w:r><w:t>q", k, "</w:t></w:r></w:p>", when(para("<w:drawing><wp:inline><a:blip r:embed='r1'/></wp:inline></w:drawing>"), k % 2 == 0), when(para("<w:pict><v:imagedata r:id='r2'/></w:pict>"), k % 3 == 0), when(para(shape), k % 3 == 1),
        when("<w:p><m:oMath><m:r><m:t>y</m:t></m:r></m:oMath></w:p>", k % 4 == 0), when(para("<w:t>![t](x/Image1.gif)</w:t>"), k % 5 == 0),
    )
    rel = lambda i, t: f'<Relationship Id="{i}" Target="{t}"/>'
    rels = f'<Relationships xmlns="{D.NS["rel"]}">{rel("r1", "media/a.JPEG")}{rel("r2", "/word/media/b.emf")}{rel("r3", "media/m.wmf")}{rel("r4", "embeddings/o1.bin")}</Relationships>'
    digit = lambda x, n: F.concat(F.lit(x), (k % n).cast("string"))
    members = {"word/document.xml": doc, "word/_rels/document.xml.rels": rels, "word/media/a.JPEG": "j", "word/media/b.emf": digit("e", 6), "word/media/m.wmf": digit("w", 2), "word/embeddings/o1.bin": F.when(k % 4 == 0, "..<math><mi></math>..").when(k % 4 == 2, "..<math><msup><mi>q</mi><mn>2</mn></msup></math>..").otherwise("no")}
    return files(table(spark, sf_dir, "supplier"), "s_suppkey", members)


def _pngs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("e0",), ("w1",)], "text string").select(F.sha1("text").alias("sha1"))


NL = "chr(10)||chr(10)"
VECTOR = "printf('glyph%03d', 1 + (s_suppkey % 2 = 0)::INTEGER) || CASE WHEN s_suppkey % 6 = 0 THEN '.png' ELSE '.emf' END"
FIRST = "CASE WHEN s_suppkey % 2 = 0 THEN 'image/image001.jpg' WHEN s_suppkey % 3 = 0 THEN 'image/glyph001.emf' ELSE 'x/Image1.gif' END"
# A formula's number: displayed ones and loose ones come before objects.
OBJECT = "printf('%03d', 1 + (s_suppkey % 4 = 0)::INTEGER)"


@query(
    f"""SELECT s_suppkey, 'q' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN {NL} || '![](image/image001.jpg)' ELSE '' END || CASE WHEN s_suppkey % 3 = 0 THEN {NL} || '![](image/' || {VECTOR} || ')' ELSE '' END
    || CASE WHEN s_suppkey % 3 = 1 THEN {NL} || '![' || {OBJECT} || '](image/formula' || {OBJECT} || CASE WHEN s_suppkey % 2 = 1 THEN '.png)' ELSE '.wmf)' END ELSE '' END || CASE WHEN s_suppkey % 4 = 0 THEN {NL} || '$y$' ELSE '' END
    || CASE WHEN s_suppkey % 5 = 0 THEN {NL} || '![t](' || {FIRST} || ')' ELSE '' END || chr(10) AS md FROM supplier"""
)
def docx_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.to_markdown(_pictured(spark, sf_dir), by="s_suppkey", pngs=_pngs(spark)).select("s_suppkey", "md")


@query("SELECT s_suppkey, (s_suppkey % 4 = 0)::INTEGER + (s_suppkey % 3 = 1)::INTEGER AS formulas, (s_suppkey % 4 = 0)::INTEGER AS math_converted, (s_suppkey % 2 = 0)::INTEGER + (s_suppkey % 3 = 0)::INTEGER AS image_count FROM supplier")
def conversion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.conversion_counts(convert.to_markdown(_pictured(spark, sf_dir), by="s_suppkey"), "s_suppkey")


@query(
    """SELECT count(*) AS files, count(*) FILTER (s_suppkey % 7 = 6) AS failed, sum(CASE WHEN s_suppkey % 7 = 6 THEN 0 ELSE s_suppkey % 3 + s_suppkey % 4 + (s_suppkey % 4 < 2)::BIGINT END)::BIGINT AS formulas,
    sum(CASE WHEN s_suppkey % 7 = 6 THEN 0 ELSE s_suppkey % 3 + s_suppkey % 4 END)::BIGINT AS math_converted, 0::BIGINT AS images FROM supplier"""
)
def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.batch_counts(convert.to_markdown(sample(spark, sf_dir), by="s_suppkey"), "s_suppkey")


@query(
    f"""SELECT s_suppkey, u.path, u.data FROM supplier, LATERAL (SELECT * FROM (VALUES ('image/image001.jpg', 'j', s_suppkey % 2 = 0), ('image/' || {VECTOR}, 'e' || s_suppkey % 6, s_suppkey % 6 = 3),
    ('image/formula' || {OBJECT} || '.wmf', 'w' || s_suppkey % 2, s_suppkey % 3 = 1)) v(path, data, here)) u WHERE u.here"""
)
def docx_image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _pictured(spark, sf_dir)
    made = convert.image_files(docs, convert.to_markdown(docs, by="s_suppkey", pngs=_pngs(spark)), "s_suppkey")
    return made.select("s_suppkey", "path", F.decode("data", "UTF-8").alias("data"))


@query(
    """SELECT s_suppkey, s_suppkey % 3 = 1 AS replaced, CASE WHEN s_suppkey % 3 = 1 THEN '$' || CASE s_suppkey % 4 WHEN 0 THEN '【MathML转LaTeX失败】' WHEN 2 THEN 'q^{2}' ELSE '【无法提取】' END || '$' END AS put,
    CASE WHEN s_suppkey % 3 = 1 THEN 5 ELSE 6 END::BIGINT AS parts, CASE WHEN s_suppkey % 3 = 1 THEN 2 ELSE 4 END::BIGINT AS rels FROM supplier"""
)
def docx_without_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects replaced by their LaTeX, and what is left in the rewritten file."""
    made = convert.without_objects(_pictured(spark, sf_dir), "s_suppkey")
    parts = D.parts(made, "s_suppkey")
    texts = D.nodes(parts.where(F.col("part").rlike(r"\.(xml|rels)\z")), "s_suppkey").groupBy("s_suppkey").agg(F.max(F.when(F.col("text").startswith("$"), F.col("text"))).alias("put"), F.count_if(F.col("local") == "Relationship").alias("rels"))
    sizes = parts.groupBy("s_suppkey").agg(F.count("*").alias("parts"))
    return made.select("s_suppkey", (F.size("formulas") > 0).alias("replaced")).join(texts, "s_suppkey").join(sizes, "s_suppkey").select("s_suppkey", "replaced", "put", "parts", "rels")


@query("SELECT s_suppkey, '001' AS formula_id, sha1('w' || s_suppkey % 2) AS sha1, 'image/formula001' || CASE WHEN s_suppkey % 2 = 1 THEN '.png' ELSE '.wmf' END AS image_path FROM supplier WHERE s_suppkey % 3 = 1")
def formula_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = D.parts(_pictured(spark, sf_dir), "s_suppkey")
    nodes = D.nodes(parts.where(F.col("part").rlike(r"\.(xml|rels)\z")), "s_suppkey")
    marks = nodes.where((F.col("local") == "imagedata") & (F.col("depth") == 6)).select("s_suppkey", F.lit("001").alias("formula_id"), F.col("attrs")[f"{{{D.NS['r']}}}id"].alias("rid"))
    return P.formula_pictures(marks, D.relationships(nodes, "math", "s_suppkey"), parts, _pngs(spark), "s_suppkey")


@query(f"SELECT s_suppkey, '## ' || s_name || {NL} || '1. first ' || s_suppkey || {NL} || '【答案】A' || {NL} || '2、second' || {NL} || '**bold** a<b ${{x}}^{{2}}$[link](http://a.b/c)' || {NL} || '| h |' || chr(10) || '| --- |' || chr(10) || '| c |' || chr(10) AS md FROM supplier")
def docx_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.to_markdown(_files(spark, sf_dir), by="s_suppkey").select("s_suppkey", "md")


@query(
    f"""SELECT s_suppkey, 'imp-q-' || q || '-' || substr(sha1(s_suppkey || '|' || stem), 1, 8) AS id, q AS "index", split_part(stem, chr(10), 1) AS stem1, CASE q WHEN 1 THEN 'A' ELSE '' END AS answer FROM
    (SELECT s_suppkey, u.q, CASE u.q WHEN 1 THEN 'first ' || s_suppkey ELSE 'second' || {NL} || '**bold** a<b ${{x}}^{{2}}$[link](http://a.b/c)' || {NL} || '| h |' || chr(10) || '| --- |' || chr(10) || '| c |' END AS stem
    FROM supplier, (SELECT unnest([1, 2])::BIGINT AS q) u)"""
)
def docx_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = convert.to_markdown(_files(spark, sf_dir), by="s_suppkey")
    return convert.questions(md, by="s_suppkey").select("s_suppkey", "id", "index", F.element_at(F.split("stem", "\n"), 1).alias("stem1"), "answer")


@query(
    r"""SELECT s_suppkey, 1::BIGINT AS "index", 'a <span class="katex">\frac{1}{' || s_suppkey || '}</span><br/><strong>b</strong>' AS stem_html, '' AS answer_html, '第 1 题未找到【答案】/【分析】/【详解】标记。' AS tip,
    'a [公式]b' AS stem_text FROM supplier"""
)
def paper_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("\ufeff1\\. a \\$\\frac { 1 } { "), F.col("s_suppkey").cast("string"), F.lit(" }$\r\n**b**"))
    made = convert.parse_papers(table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text")), by="s_suppkey")
    rows = made.select("s_suppkey", F.element_at("notices", 2)["text"].alias("tip"), F.explode("questions").alias("q"))
    return rows.select("s_suppkey", "q.index", "q.stem_html", "q.answer_html", "tip", "q.stem_text")


@query(
    """SELECT s_suppkey, u.source, u.mathml, u.latex FROM supplier, LATERAL (SELECT * FROM (VALUES ('oleObject1.bin', NULL, '【无法提取】'),
    ('oleObject2.bin', CASE WHEN s_suppkey % 3 = 0 THEN '<math><mi>q</math>' ELSE '<math><mfrac><mi>q</mi><mn>' || s_suppkey || '</mn></mfrac></math>' END,
     CASE WHEN s_suppkey % 3 = 0 THEN '【MathML转LaTeX失败】' ELSE '\\frac{q}{' || s_suppkey || '}' END)) v(source, mathml, latex)) u"""
)
def ole_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.embedded_formulas(_files(spark, sf_dir), "s_suppkey")


@query(r"SELECT l_orderkey, l_linenumber, '\frac { ' || l_linenumber || ' } { ' || (l_quantity::BIGINT % 10) || ' }' AS latex FROM lineitem")
def mtef_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    digit = lambda c: F.concat(F.lit(b"\x02\x00\x83"), F.encode(c.cast("string"), "UTF-8"), F.lit(b"\x00"))
    slot = lambda c: F.concat(F.lit(b"\x01\x00"), digit(c), F.lit(b"\x00"))
    head = bytes([5, 1, 0, 5, 0]) + b"DSMT\0" + b"\0" + b"\x0a\x01\x00\x03\x00\x0b\x00\x00"
    size = len(head) + 2 * 8 + 3
    native = struct.pack("<HIH", 28, 0, 0) + struct.pack("<I", size) + bytes(16) + head
    made = F.concat(F.lit(native), slot(F.col("l_linenumber")), slot(F.col("l_quantity").cast("long") % 10), F.lit(b"\x00\x00\x00"))
    return spread(table(spark, sf_dir, "lineitem"), ROWS).select("l_orderkey", "l_linenumber", E.mtef_to_latex(made).alias("latex"))


def _native(body: bytes) -> tuple[bytes, bytes]:
    """Header and records with one line, cut where its first ``@`` stands."""
    head = bytes([5, 1, 0, 5, 0]) + b"DSMT\0" + b"\0" + b"\x0a\x01\x00"
    records = head + body + b"\0\0"
    whole = struct.pack("<HIH", 28, 0, 0) + struct.pack("<I", len(records)) + bytes(16) + records
    before, _, after = whole.partition(b"@")
    return before, after


def _char(c: str, face: int = 0x83) -> bytes:
    return bytes([2, 0, face]) + struct.pack("<H", ord(c))


def _slot(*xs: bytes) -> bytes:
    return b"\x01\x00" + b"".join(xs) + b"\0"


MAIN = _slot(_char("@"))
LOW, HIGH = _slot(_char("1")), _slot(_char("n"))
#: selector, variation, slots, LaTeX with # for the digit
TEMPLATES = [
    (0, 0, [MAIN, _char("("), _char(")")], r"\left ( { # } \right )"), (1, 0, [MAIN, _char("("), _char(")")], r"\left ( { # } \right )"), (9, 0, [MAIN, _char("["), _char("]")], r"\left [ { # } \right ]"),
    (2, 0, [MAIN, _char("{")], r"\left \{ \begin{array}{l} # \end{array} \right."), (3, 0, [MAIN, _char("["), _char("]")], r"\left[ # \right]"), (4, 0, [MAIN, _char("|"), _char("|")], r"\left \| { # } \right  \|"),
    (10, 0, [MAIN, LOW], r"\sqrt[1] { # }"), (11, 0, [MAIN, LOW], r"\frac { # } { 1 }"), (12, 0, [MAIN], r"{\underline{ # }}"), (14, 0x20, [MAIN, _slot()], r"\xrightarrow  {\mathrm{ # }}"),
    (16, 0, [MAIN, LOW, HIGH, _char("\u2211")], "\u2211 \\limits_{ 1 } ^ n { # }"), (23, 0, [MAIN, LOW], r"\mathop { # } \limits_{ 1 }"), (27, 0, [MAIN, HIGH], "_{ # }  ^{ n }"), (28, 0, [_slot(), MAIN], "^ { # }"),
    (29, 0, [MAIN, HIGH], "_{ # }  ^{ n }"), (31, 2, [MAIN], r"\overset\rightarrow { # }"), (33, 0, [MAIN, LOW], "1  { # }"), (34, 0, [MAIN, LOW], r"\overset 1 { # }"), (15, 0, [MAIN], ""), (11, 0, [MAIN], ""),
]
_VALUES = ", ".join(f"({k}, '{latex.replace(chr(39), chr(39) * 2)}')" for k, (*_, latex) in enumerate(TEMPLATES))


@query(f"SELECT s_suppkey, u.k::INTEGER AS k, replace(u.latex, '#', (s_suppkey % 10)::VARCHAR) AS latex FROM supplier, (SELECT * FROM (VALUES {_VALUES}) v(k, latex)) u")
def mtef_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every template that is known, one that isn't, and one with a slot too few."""
    made = []
    for k, (selector, variation, slots, _) in enumerate(TEMPLATES):
        before, after = _native(bytes([3, 0, selector, variation, 0]) + b"".join(slots) + b"\0")
        digit = F.encode((F.col("s_suppkey") % 10).cast("string"), "UTF-8")
        made.append(F.struct(F.lit(k).alias("k"), F.concat(F.lit(before), digit, F.lit(after)).alias("native")))
    rows = spread(table(spark, sf_dir, "supplier"), FILES).select("s_suppkey", F.explode(F.array(*made)).alias("m"))
    return rows.select("s_suppkey", "m.k", E.mtef_to_latex("m.native").alias("latex"))


#: code in the symbol font, LaTeX
SYMBOLS = [
    (0x3B1, "\\alpha "), (0x3BB, "\\lambda "), (0x3A9, "\\Omega "), (0x3B5, "\\varepsilon "), (0xC0, "\\grave{A}"), (0x10D, "\\check{c}"), (0xF000, "\\mathfrak{A}"), (0xF01A, "\\mathfrak{a}"), (0xF08B, "\\mathbb{L}"), (0xF109, "\\mathcal{J}"),
    (0x24, "\\$"), (0x221E, "\\infty "), (0x2264, "\\le "), (0x2265, "\\ge "), (0x2208, "\\in "), (0x2209, "\\notin "), (0x2192, "\\to "), (0x21D2, "\\Rightarrow "), (0xB1, "\\pm "), (0xD7, "\\times "), (0x222B, "\\int "), (0x2211, "\\sum "),
    (0x2284, "\\not\\subset "), (0x2286, "\\subseteq "), (0x211D, "\\mathbb{R}"), (0x210B, "\\mathcal{H}"), (0x212D, "\\mathfrak{C}"), (0xB2, "{}^\\text{2}"), (0x25B3, "\\vartriangle "), (0x27F9, "\\Longrightarrow "), (0xE930, "\\leqslant "),
    (0xEF05, "\\quad "), (0x2254, ":=\\,\\!"), (0x20AC, "\\euro "), (0x2A01, "\\bigoplus "), (0x228D, "⊍"), (0x3BF, "ο"), (0x219F, "↟"), (0x41, "A"), (0x3A, "\\:"),
]


@query(f"SELECT s_suppkey, u.k::INTEGER AS k, u.latex || (s_suppkey % 10) AS latex FROM supplier, (SELECT * FROM (VALUES {', '.join(f'({k}, {chr(39)}{x}{chr(39)})' for k, (_, x) in enumerate(SYMBOLS))}) v(k, latex)) u")
def mtef_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of the symbol font before a digit."""
    made = []
    for k, (code, _) in enumerate(SYMBOLS):
        before, after = _native(_char(chr(code), E.EXTRA) + _char("@"))
        digit = F.encode((F.col("s_suppkey") % 10).cast("string"), "UTF-8")
        made.append(F.struct(F.lit(k).alias("k"), F.concat(F.lit(before), digit, F.lit(after)).alias("native")))
    rows = spread(table(spark, sf_dir, "supplier"), FILES).select("s_suppkey", F.explode(F.array(*made)).alias("m"))
    return rows.select("s_suppkey", "m.k", E.mtef_to_latex("m.native").alias("latex"))


#: MathML and its LaTeX with # for a number; null: no MathML or none that says anything.
MATHML = [
    ("<math><mfrac><mn>#</mn><mi>x</mi></mfrac></math>", r"\frac{#}{x}"),
    ("<math><mfrac linethickness='0'><mi>n</mi><mn>#</mn></mfrac><mfrac bevelled='true'><mi>x</mi><mi>y</mi></mfrac></math>", r"{n \atop#}x/y"),
    ("<m:math><m:msubsup><m:mi>&alpha;</m:mi><m:mi>i</m:mi><m:mn>#</m:mn></m:msubsup></m:math>", r"\alpha_{i}^{#}"),
    ("<math><munderover><mo>&sum;</mo><mrow><mi>i</mi><mo>=</mo><mn>#</mn></mrow><mi>n</mi></munderover><mi>i</mi></math>", r"\sum_{i=#}^{n}i"),
    ("<math><munder><mi>lim</mi><mrow><mi>x</mi><mo>&rarr;</mo><mi>&infin;</mi></mrow></munder><mi>sin</mi><mo>&ApplyFunction;</mo><mi>#</mi></math>", r"\lim_{x\to\infty}\sin#"),
    ("<math><mroot><mi>x</mi><mn>#</mn></mroot><mo>&le;</mo><msqrt><mi>a</mi><mo>&times;</mo><mi>b</mi></msqrt></math>", r"\sqrt[#]{x}\le\sqrt{a\times b}"),
    ("<math><mfenced open='[' close=')' separators=';'><mn>#</mn><mi>b</mi></mfenced></math>", r"\left[ #;b \right)"),
    ("<math><mrow><mo>|</mo><mtable><mtr><mtd><mn>#</mn></mtd><mtd><mi>b</mi></mtd></mtr><mtr><mtd><mi>c</mi></mtd><mtd><mi>d</mi></mtd></mtr></mtable><mo>|</mo></mrow></math>", r"\begin{vmatrix}# & b \\ c & d\end{vmatrix}"),
    ("<math><mrow><mo>{</mo><mtable columnalign='left'><mtr><mtd><mi>x</mi><mo>&gt;</mo><mn>#</mn></mtd></mtr><mtr><mtd><mi>y</mi></mtd></mtr></mtable></mrow></math>", r"\begin{cases}x>#  \\ y\end{cases}".replace("  ", " ")),
    ("<math><mtable columnalign='left right'><mtr><mtd><mn>#</mn></mtd><mtd><mi>b</mi></mtd></mtr></mtable></math>", r"\begin{array}{lr}# & b\end{array}"),
    ("<math><mover accent='true'><mrow><mi>A</mi><mi>B</mi></mrow><mo>&rarr;</mo></mover><mover><mi>x</mi><mo>&macr;</mo></mover><mn>#</mn></math>", r"\overrightarrow{AB}\overline{x}#"),
    ("<math><munder><munder><mrow><mi>a</mi><mo>+</mo><mi>b</mi></mrow><mo>&UnderBrace;</mo></munder><mn>#</mn></munder></math>", r"\underbrace{a+b}_{#}"),
    ("<math><mmultiscripts><mi>C</mi><mi>k</mi><none/><mprescripts/><none/><mn>#</mn></mmultiscripts><msup><mi>f</mi><mo>&prime;</mo></msup></math>", r"{}^{#}C_{k}f'"),
    ("<math><mi mathvariant='double-struck'>R</mi><mtext>up to # %</mtext><mspace width='1em'/><menclose notation='box'><mi>z</mi></menclose></math>", r"\mathbb{R}\text{up to # \%}\quad\boxed{z}"),
    ("<math><semantics><mrow><mi>a</mi><mo>&InvisibleTimes;</mo><mn>#</mn></mrow><annotation>no</annotation></semantics><mphantom><mi>w</mi></mphantom></math>", r"a#\phantom{w}"),
    ("<math><mi>#</math>", None),
    ("<math><mrow/><!-- # --></math>", None),
]
_QUOTED = ", ".join(f"({k}, {'NULL' if x is None else chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39)})" for k, (_, x) in enumerate(MATHML))


@query(f"SELECT c_custkey, u.k::INTEGER AS k, replace(u.latex, '#', (c_custkey % 97)::VARCHAR) AS latex FROM customer, (SELECT * FROM (VALUES {_QUOTED}) v(k, latex)) u")
def mathml_constructs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every construct of MathML that is known, with a number of the row in it."""
    made = [F.struct(F.lit(k).alias("k"), F.replace(F.lit(x), F.lit("#"), (F.col("c_custkey") % 97).cast("string")).alias("x")) for k, (x, _) in enumerate(MATHML)]
    rows = spread(table(spark, sf_dir, "customer"), TEXTS).select("c_custkey", F.explode(F.array(*made)).alias("m"))
    return rows.select("c_custkey", "m.k", mathml_to_latex("m.x").alias("latex"))


def _metafile(blue: Column) -> Column:
    """A placeable metafile of 72 by 36 points with a bitmap of two pixels, the first of this colour."""
    dib = struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, 24, 0, 8, 0, 0, 0, 0)
    tail = bytes([9, 8, 7, 6, 5, 0, 0])
    record = struct.pack("<IH", (6 + 22 + len(dib) + 8) // 2, 0x0F43) + bytes(22) + dib
    head = b"\xd7\xcd\xc6\x9a" + struct.pack("<HhhhhHIH", 0, 0, 0, 1440, 720, 1440, 0, 0) + struct.pack("<HHHIHIH", 1, 9, 0x300, 0, 0, 0, 0)
    return F.concat(F.lit(head + record), F.unhex(F.lpad(F.hex(blue), 2, "0")), F.lit(tail), F.lit(struct.pack("<IH", 3, 0)))


@query(
    f"""SELECT s_suppkey, 'q' || {NL} || '![](image/glyph001.' || CASE WHEN s_suppkey % 2 = 0 THEN 'png' ELSE 'wmf' END || ')' || chr(10) AS md, CASE WHEN s_suppkey % 2 = 0 THEN 72.0 END::DOUBLE AS width, CASE WHEN s_suppkey % 2 = 0 THEN 36.0 END::DOUBLE AS height,
    (s_suppkey % 2 = 0)::INTEGER AS bitmaps, CASE WHEN s_suppkey % 2 = 0 THEN '89504E470D0A1A0A0000000D49484452000000020000000108020000' ELSE '' END AS head FROM supplier"""
)
def vector_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metafiles that are a bitmap come out as PNG, those that aren't as they are."""
    k = F.col("s_suppkey")
    doc = body("<w:p><w:r><w:t>q</w:t></w:r></w:p><w:p><w:r><w:pict><v:imagedata r:id='r2'/></w:pict></w:r></w:p>")
    rels = f'<Relationships xmlns="{D.NS["rel"]}"><Relationship Id="r2" Target="media/b.wmf"/></Relationships>'
    rows = spread(table(spark, sf_dir, "supplier"), FILES).select(k, F.when(k % 2 == 0, _metafile(k % 256)).otherwise(F.encode(F.concat(F.lit("w"), k), "UTF-8")).alias("picture"))
    members = F.array(*(F.struct(F.lit(n).alias("n"), (F.encode(v if isinstance(v, Column) else F.lit(v), "UTF-8") if n[-1] != "f" else v).alias("b")) for n, v in (("word/document.xml", doc), ("word/_rels/document.xml.rels", rels), ("word/media/b.wmf", F.col("picture")))))
    docs = rows.select(k, members.alias("m")).select(k, D.pack_parts(F.col("m.n"), F.col("m.b")).alias("content"))
    pngs = V.pngs(D.parts(docs, "s_suppkey"))
    made = convert.to_markdown(docs, by="s_suppkey", pngs=pngs)
    held = convert.image_files(docs, made, "s_suppkey", pngs=pngs).where(F.endswith("path", F.lit(".png"))).select("s_suppkey", F.hex(F.substring("data", 1, 28)).alias("head"))
    told = rows.select(k, V.vector_picture("picture").alias("v")).select(k, "v.width", "v.height", "v.bitmaps")
    return made.select("s_suppkey", "md").join(told, "s_suppkey").join(held, "s_suppkey", "left").withColumn("head", F.coalesce("head", F.lit("")))
