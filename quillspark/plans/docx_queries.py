"""Queries over Word files built from table columns, so that SQL can say what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import formula_runs as R
from ..operators import inspector as I
from ..operators import omml as O
from ..sources import docx as D
from ..sources.tables import FILES, spread, table
from ..sources.tables import ROWS as LIGHT_ROWS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


HEAD = " ".join(f'xmlns:{p}="{u}"' for p, u in D.NS.items() if p != "rel")


def body(*xml) -> Column:
    return F.concat(F.lit(f"<w:document {HEAD}><w:body>"), *(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xml), F.lit("</w:body></w:document>"))


def files(rows: DataFrame, by: str, members: dict) -> DataFrame:
    """``(by, content)``: a zip per row of names and XML columns or literals; a null member is left out."""
    text = lambda v: F.encode(v if isinstance(v, Column) else F.lit(v), "UTF-8")
    items = F.filter(F.array(*(F.struct(F.lit(n).alias("n"), text(v).alias("b")) for n, v in members.items())), lambda m: m["b"].isNotNull())
    return spread(rows, FILES).select(by, items.alias("m")).select(by, D.pack_parts(F.col("m.n"), F.col("m.b")).alias("content"))


def times(xml: str, n) -> Column:
    return F.repeat(F.lit(xml), n.cast("int"))


def when(xml: str | Column, test: Column) -> Column:
    """The XML where the test holds, else nothing."""
    return F.when(test, xml if isinstance(xml, Column) else F.lit(xml)).otherwise("")


def rels_of(k: Column) -> Column:
    """Relationships of every kind of target; some files have fewer."""
    one = lambda i, t: f'<Relationship Id="{i}" Target="{t}"/>'
    return F.concat(F.lit(f'<Relationships xmlns="{D.NS["rel"]}">'), F.lit(one("r1", "media/a.png")), when(one("r2", "/word/media/b.wmf"), k % 2 == 0), when(one("r3", "word/x.xml"), k % 3 == 0), F.lit("</Relationships>"))


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per supplier; what is in it and how often follows from its number, and in some the body is no XML."""
    K = F.col("s_suppkey")  # noqa: N806
    tag = lambda x, root: f'<w:{root} xmlns:w="{D.NS["w"]}" xmlns:v="{D.NS["v"]}">{x}</w:{root}>'
    prog = F.when(K % 4 == 0, "Equation.DSMT4").when(K % 4 == 1, "Equation.3").otherwise("Excel.Sheet.8")
    doc = body(
        "<w:p><w:pPr><w:pStyle w:val='", F.when(K % 2 == 0, "Heading1").otherwise("Normal"), "'/></w:pPr><w:r><w:t>", F.col("s_name"), "</w:t></w:r></w:p>",
        times("<w:p/>", K % 4), "<w:p><w:r><w:t> </w:t></w:r></w:p><w:p>", times("<w:ins><w:r><w:t>in</w:t></w:r></w:ins>", K % 3), times("<w:del><w:r><w:t>out</w:t></w:r></w:del><w:commentRangeStart/>", K % 2),
        when("<w:r><w:rPr><w:vanish/></w:rPr><w:t>hid</w:t></w:r>", K % 5 == 0), "<w:r>", when("<w:br w:type='page'/>", K % 3 == 1), "<w:t>a\tb</w:t>", times("<w:tab/>", K % 2), "</w:r></w:p>",
        times("<m:oMathPara><m:oMath><m:r><m:t>x</m:t></m:r></m:oMath></m:oMathPara>", K % 3), times("<w:p><m:oMath><m:r><m:t>y</m:t></m:r></m:oMath></w:p>", K % 4),
        when(F.concat(F.lit("<w:p><w:r><w:object><o:OLEObject ProgID='"), prog, F.lit("' r:id='r8'/></w:object></w:r></w:p>")), K % 4 != 3), times("<w:tbl><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl>", K % 3),
        times("<w:sectPr><w:footerReference/></w:sectPr>", K % 3), times("<w:sectPr><w:type w:val='continuous'/></w:sectPr>", K % 2),
    )
    note = lambda name, n: F.concat(F.lit(f'<w:{name}s xmlns:w="{D.NS["w"]}"><w:{name} w:type="separator"/>'), times(f"<w:{name}/>", n), F.lit(f"</w:{name}s>"))
    foot = F.when(K % 3 == 0, tag("<w:p><w:r><w:t>PAGE 1</w:t></w:r></w:p>", "ftr")).when(K % 3 == 1, tag("<w:p/>", "ftr"))
    members = {
        "word/document.xml": F.when(K % 7 == 6, "<w:document").otherwise(doc), "word/_rels/document.xml.rels": rels_of(K), "word/footer1.xml": foot, "word/header1.xml": F.when(K % 4 == 2, tag("<w:p><v:imagedata/></w:p>", "hdr")),
        "word/footnotes.xml": note("footnote", K % 4), "word/endnotes.xml": F.when(K % 2 == 1, note("endnote", K % 3)), "word/media/b.wmf": F.lit("x"), "word/media/a.png": F.when(K % 2 == 0, "y"), "word/media/c.emf": F.when(K % 3 == 0, "y"),
        "word/media/e.PNG": F.when(K % 4 == 0, "y"), "word/embeddings/o.bin": F.when(K % 4 == 0, "z"), "word/comments.xml": F.when(K % 4 == 1, "<c/>"),
    }
    return files(table(spark, sf_dir, "supplier"), "s_suppkey", members)


# What the files hold, for the oracles: k the number, z 0 where the body is no XML, and parts in their order.
BASE = """WITH b AS (SELECT *, z * (k % 3) AS ins, z * (k % 2) AS dels, z * (k % 3 + k % 4) AS o_math, z * (k % 3) AS paras, z * (k % 4 = 0)::BIGINT AS mathtype, z * (k % 3) AS tables, z * (k % 2) AS odd,
  1 + (k % 3 = 0)::BIGINT AS vectors, (k % 2 = 0)::BIGINT + (k % 4 = 0)::BIGINT AS rasters, z * (k % 3 = 1)::BIGINT AS pages, z * (k % 5 = 0)::BIGINT AS hidden, z * (k % 4 + 1 + k % 3) AS blanks
  FROM (SELECT s_suppkey, s_name, s_suppkey AS k, (s_suppkey % 7 <> 6)::BIGINT AS z FROM supplier)),
p AS (SELECT k, s_suppkey, s_name, u.part, (row_number() OVER (PARTITION BY k ORDER BY u.o) - 1)::INTEGER AS ord FROM b, LATERAL (SELECT * FROM (VALUES (0, 'word/document.xml', true), (1, 'word/_rels/document.xml.rels', true),
  (2, 'word/footer1.xml', k % 3 <> 2), (3, 'word/header1.xml', k % 4 = 2), (4, 'word/footnotes.xml', true), (5, 'word/endnotes.xml', k % 2 = 1), (6, 'word/media/b.wmf', true), (7, 'word/media/a.png', k % 2 = 0),
  (8, 'word/media/c.emf', k % 3 = 0), (9, 'word/media/e.PNG', k % 4 = 0), (10, 'word/embeddings/o.bin', k % 4 = 0), (11, 'word/comments.xml', k % 4 = 1)) v(o, part, here)) u WHERE u.here)
"""


def _xml(spark: SparkSession, sf_dir: str, document: bool = True) -> DataFrame:
    parts = D.parts(sample(spark, sf_dir), "s_suppkey")
    return parts.where("part = 'word/document.xml'") if document else parts.where(F.col("part").endswith(".xml"))


@query(f"{BASE} SELECT s_suppkey, ord, part FROM p")
def zip_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.parts(sample(spark, sf_dir), "s_suppkey").select("s_suppkey", "ord", "part")


@query(
    """SELECT s_suppkey, u.rule, u.rid, u.target FROM supplier, (SELECT * FROM (VALUES ('math', 'r1', 'word/media/a.png', 1), ('math', 'r2', 'word/media/b.wmf', 2), ('math', 'r3', 'word/word/x.xml', 3), ('image', 'r1', 'word/media/a.png', 1),
    ('image', 'r2', 'word/word/media/b.wmf', 2), ('image', 'r3', 'word/x.xml', 3), ('raw', 'r1', 'media/a.png', 1), ('raw', 'r2', '/word/media/b.wmf', 2), ('raw', 'r3', 'word/x.xml', 3)) v(rule, rid, target, every)) u WHERE s_suppkey % u.every = 0"""
)
def rels_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = D.nodes(D.parts(sample(spark, sf_dir), "s_suppkey").where(F.col("part").endswith(".rels")), "s_suppkey")
    rules = [D.relationships(nodes, r, "s_suppkey").select("s_suppkey", F.lit(r).alias("rule"), "rid", "target") for r in ("math", "image", "raw")]
    return rules[0].unionByName(rules[1]).unionByName(rules[2])


@query(f"{BASE} SELECT s_suppkey, part, row_number() OVER (PARTITION BY s_suppkey ORDER BY part)::INTEGER AS n FROM p WHERE part LIKE 'word/media/%'")
def media_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = D.members_under(D.parts(sample(spark, sf_dir), "s_suppkey"), "word/media/")
    return media.select("s_suppkey", "part", F.row_number().over(Window.partitionBy("s_suppkey").orderBy("part")).alias("n"))


@query(f"{BASE} SELECT s_suppkey, ins, dels, o_math, paras AS o_math_para, hidden AS vanish, tables, odd AS tabs, tables + odd AS sections, pages AS page_breaks FROM b WHERE z = 1")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.tag_counts(D.nodes(_xml(spark, sf_dir), "s_suppkey"), "s_suppkey").select("s_suppkey", "ins", "dels", "o_math", "o_math_para", "vanish", "tables", "tabs", "sections", "page_breaks")


@query(f"{BASE} SELECT s_suppkey, u.type, u.n FROM b, LATERAL (SELECT * FROM (VALUES ('nextPage(default)', tables), ('continuous', odd)) v(type, n)) u WHERE u.n > 0")
def section_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.section_types(D.nodes(_xml(spark, sf_dir), "s_suppkey"), "s_suppkey")


@query(f"{BASE} SELECT s_suppkey, k % 4 AS footnotes, CASE WHEN k % 2 = 1 THEN k % 3 ELSE 0 END AS endnotes FROM b")
def note_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.notes(D.nodes(_xml(spark, sf_dir, False), "s_suppkey"), "s_suppkey")


@query(f"{BASE} SELECT s_suppkey, 3 + 2 * (k % 4) + (k % 4 <> 3)::BIGINT + k % 3 AS paragraphs, blanks AS empty_paragraphs, 1 - k % 2 AS headings, greatest(k % 4 + 1, k % 3) AS max_empty_run FROM b WHERE z = 1")
def heading_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.paragraph_counts(D.paragraphs(_xml(spark, sf_dir), "s_suppkey"), "s_suppkey")


@query(
    f"""{BASE} SELECT s_suppkey, (k % 4 = 2)::BIGINT AS header_parts, (k % 3 <> 2)::BIGINT AS footer_parts, (k % 4 = 2)::BIGINT AS nonempty_headers, (k % 3 = 0)::BIGINT AS nonempty_footers, k % 3 = 0 AS page_number_fields,
    concat_ws(';', CASE WHEN k % 4 = 2 THEN 'word/header1.xml=(含图片/域)' END, CASE WHEN k % 3 = 0 THEN 'word/footer1.xml=PAGE 1' END) AS sample FROM b WHERE k % 4 = 2 OR k % 3 <> 2"""
)
def header_footer_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = I.header_footer(D.nodes(_xml(spark, sf_dir, False), "s_suppkey"), "s_suppkey")
    told = F.array_join(F.transform("header_samples", lambda s: F.concat_ws("=", s["part"], s["preview"])), ";")
    return info.withColumn("sample", told).drop("header_samples")


@query(
    f"""{BASE}, m AS (SELECT s_suppkey, ord, part[12:] AS name, lower('.' || split_part(part, '.', 2)) AS ext FROM p WHERE part LIKE 'word/media/%'),
    n AS (SELECT s_suppkey, count(*)::INTEGER AS media, string_agg(name, ',' ORDER BY ord) AS sample FROM m GROUP BY 1), e AS (SELECT s_suppkey, ext, count(*) AS n FROM m GROUP BY 1, 2)
    SELECT s_suppkey, ext, n, row_number() OVER (PARTITION BY s_suppkey ORDER BY n DESC, ext)::INTEGER AS place, media, sample FROM e JOIN n USING (s_suppkey)"""
)
def media_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = D.parts(sample(spark, sf_dir), "s_suppkey")
    names = I.media_sample(parts, by="s_suppkey").withColumn("sample", F.array_join("sample", ","))
    return I.media_by_extension(parts, by="s_suppkey").join(names, "s_suppkey")


@query(f"{BASE} SELECT s_suppkey, '.bin' AS ext, 1::BIGINT AS n, 1 AS place FROM b WHERE k % 4 = 0")
def embeddings_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.media_by_extension(D.parts(sample(spark, sf_dir), "s_suppkey"), "word/embeddings/", "s_suppkey")


@query(f"{BASE} SELECT s_suppkey, CASE k % 4 WHEN 0 THEN 'Equation.DSMT4' WHEN 1 THEN 'Equation.3' ELSE 'Excel.Sheet.8' END AS prog, 1::BIGINT AS n FROM b WHERE z = 1 AND k % 4 <> 3")
def ole_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.ole_programs(D.nodes(_xml(spark, sf_dir), "s_suppkey"), "s_suppkey").drop("first_node")


SUMMARY = "CASE WHEN mathtype > 0 THEN 'mathtype_ole' WHEN o_math > 0 THEN 'omml' ELSE 'wmf_emf' END"


@query(
    f"""{BASE} SELECT s_suppkey, {SUMMARY} AS primary, concat_ws('；', CASE WHEN mathtype > 0 THEN 'MathType 1 个' END, CASE WHEN o_math > 0 THEN 'OMML ' || paras || ' 段+' || o_math || ' 个' END, 'WMF/EMF ' || vectors || ' 张',
    CASE WHEN ins + dels > 0 THEN '含修订' END, CASE WHEN odd > 0 THEN '含批注' END) || '。' AS summary, CASE WHEN z = 0 THEN 'word/document.xml is no XML' END AS error FROM b"""
)
def inspect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.inspect(sample(spark, sf_dir), "s_suppkey").select("s_suppkey", "primary", "summary", "error")


@query(
    f"""{BASE} SELECT s_suppkey, u.kind, u.n AS count FROM b, LATERAL (SELECT * FROM (VALUES ('omml_display', paras), ('omml_inline', z * (k % 4)), ('mathtype_ole', mathtype), ('ms_equation_ole', z * (k % 4 = 1)::BIGINT), ('other_ole', z * (k % 4 = 2)::BIGINT),
    ('wmf_emf', vectors), ('raster', rasters), ('drawingml', 0::BIGINT), ('latex_text', 0::BIGINT)) v(kind, n)) u"""
)
def inspect_math_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.inspect(sample(spark, sf_dir), "s_suppkey").select("s_suppkey", F.explode("types").alias("t")).select("s_suppkey", "t.kind", "t.count")


ROWS = """(SELECT * FROM (VALUES ('修订 / 跟踪更改', ins + dels, '插入 ' || ins || '，删除 ' || dels || '，属性更改 0', ins + dels > 0), ('批注', odd, 'comments.xml=' || CASE WHEN k % 4 = 1 THEN '有' ELSE '无' END || '，标记 ' || odd, k % 4 = 1 OR odd > 0),
  ('页眉', (k % 4 = 2)::BIGINT, '1 个页眉部件，非空 1', k % 4 = 2), ('页脚', 1::BIGINT, '1 个页脚部件，非空 1', k % 3 = 0), ('页码域', 1::BIGINT, 'PAGE / NUMPAGES 域（正文或页眉页脚）', k % 3 = 0),
  ('分节符', tables + odd, '类型: ' || concat_ws(', ', CASE WHEN odd > 0 THEN 'continuous×' || odd END, CASE WHEN tables > 0 THEN 'nextPage(default)×' || tables END), tables + odd > 1),
  ('分页符', pages, '显式分页 1，渲染分页标记 0', pages > 0), ('空段落', blanks, '共 ' || (3 + 2 * (k % 4) + (k % 4 <> 3)::BIGINT + k % 3) || ' 段，空段 ' || blanks || '，最长连续空段 ' || greatest(k % 4 + 1, k % 3), blanks > 0),
  ('隐藏文字', hidden, 'w:vanish', hidden > 0), ('脚注', k % 4, 'word/footnotes.xml', k % 4 > 0), ('尾注', k % 3, 'word/endnotes.xml', k % 2 = 1 AND k % 3 > 0), ('表格', tables, 'w:tbl', tables > 0), ('制表符', odd, 'w:tab', odd > 0),
  ('标题样式段落', 1::BIGINT, 'Heading / 标题样式', z = 1 AND k % 2 = 0)) v(name, n, detail, present))"""


@query(f"{BASE} SELECT s_suppkey, u.name, u.n AS count, u.detail, '有' AS status FROM b, LATERAL {ROWS} u WHERE u.present")
def inspect_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.inspect(sample(spark, sf_dir), "s_suppkey").select("s_suppkey", F.explode("rows").alias("r")).where("r.present")
    return rows.select("s_suppkey", "r.name", "r.count", "r.detail", "r.status")


@query(
    f"""{BASE} SELECT s_suppkey, u.level, u.item FROM b, LATERAL (SELECT * FROM (VALUES (CASE WHEN mathtype = 0 AND o_math > 0 THEN '中' ELSE '高' END, CASE {SUMMARY} WHEN 'mathtype_ole' THEN '主体公式是 MathType OLE' WHEN 'omml' THEN '主体公式是 OMML' ELSE '公式主要是 WMF/EMF 图' END)) v(level, item)
    UNION ALL SELECT '中', r.name FROM {ROWS} r WHERE r.present AND r.name IN ('修订 / 跟踪更改', '批注', '页眉', '页脚', '分页符', '空段落')) u"""
)
def inspect_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.inspect(sample(spark, sf_dir), "s_suppkey").select("s_suppkey", F.explode("impact").alias("i")).select("s_suppkey", "i.level", "i.item")


@query(f"{BASE} SELECT s_suppkey, {SUMMARY} AS primary, 25 AS n_rows, CASE WHEN z = 0 THEN 'word/document.xml is no XML' END AS error FROM b")
def inspect_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON report, read back."""
    text = I.report(I.inspect(sample(spark, sf_dir), "s_suppkey"), "s_suppkey")
    got = lambda path: F.get_json_object("report", path)
    return text.select("s_suppkey", got("$.math.primary").alias("primary"), F.json_array_length(got("$.structure.rows")).alias("n_rows"), got("$.error").alias("error"))


def _texts(rows: DataFrame) -> DataFrame:
    """The body's paragraphs as one string, joined by a bar."""
    body_rows = D.paragraphs(rows.where("part = 'word/document.xml'"), "s_suppkey")
    return body_rows.groupBy("s_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "|").alias("said"))


LAST = "'a' || chr(9) || 'b' || repeat('|', (k % 4 + (k % 4 <> 3)::BIGINT + k % 3)::BIGINT)"


@query(f"{BASE} SELECT s_suppkey, s_name || repeat('|', k % 4) || '| |' || repeat('in', k % 3) || CASE WHEN k % 5 = 0 THEN 'hid' ELSE '' END || {LAST} AS said FROM b WHERE z = 1")
def clean_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(C.clean(D.parts(sample(spark, sf_dir), "s_suppkey"), "basic", "s_suppkey"))


@query(f"{BASE} SELECT s_suppkey, s_name || '|' || repeat('in', k % 3) || {LAST} AS said FROM b WHERE z = 1")
def clean_aggressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(C.clean(D.parts(sample(spark, sf_dir), "s_suppkey"), "aggressive", "s_suppkey"))


@query(f"{BASE} SELECT s_suppkey, z + odd AS tabs_replaced, (k % 3 <> 2)::BIGINT AS footers_cleared, z * (k % 4 + 1) AS empty_paragraphs_removed FROM b")
def preprocess_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.preprocess_stats(D.parts(sample(spark, sf_dir), "s_suppkey"), "s_suppkey")


@query(f"{BASE} SELECT s_suppkey, count(*) AS n, CASE WHEN s_suppkey % 7 = 6 THEN '' ELSE any_value(s_name) END AS heading FROM p GROUP BY s_suppkey")
def rebuild_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = D.parts(D.rebuild(D.parts(sample(spark, sf_dir), "s_suppkey"), "s_suppkey"), "s_suppkey")
    heading = F.regexp_extract(F.decode("data", "UTF-8"), "<w:t>([^<]*)</w:t>", 1)
    return again.groupBy("s_suppkey").agg(F.count("*").alias("n"), F.max(F.when(F.col("part") == "word/document.xml", heading)).alias("heading"))


@query(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN '/out/' || s_name || '.md' ELSE '/out/' || CASE WHEN s_suppkey % 3 = 1 THEN 'deep/er/' ELSE '' END || s_name || CASE WHEN s_suppkey % 5 = 0 THEN '.doc' ELSE '.md' END END AS path FROM supplier"""
)
def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs mirror the folders below the root; a file elsewhere keeps its name."""
    k = F.col("s_suppkey")
    folder = F.when(k % 3 == 0, "file:/data/in/").when(k % 3 == 1, "file:/data/in/deep/er/").otherwise("file:/other/")
    path = F.concat(folder, "s_name", F.when((k % 5 == 0) & (k % 3 != 2), ".doc").when(k % 2 == 0, ".docx").otherwise(".DOCX"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", D.output_path(path, "file:/data/in/", "/out").alias("path"))


@query(
    r"""SELECT l_orderkey, l_linenumber, '\dfrac{' || q || '}{' || l_linenumber || '}' AS fraction, '{' || q || '}^{' || l_linenumber || '}' AS power, '\sqrt[' || l_linenumber || ']{' || q || '}' AS root,
    '\int _{0}^{' || q || '}{x\le \%}' AS integral, '\sin{' || q || '}' AS sine, '\begin{aligned}a \\ ' || q || '\end{aligned}' AS lines
    FROM (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS q FROM lineitem)"""
)
def omml_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, n = F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber").cast("string")
    r = lambda x: F.concat(F.lit("<m:r><m:t>"), x if isinstance(x, Column) else F.lit(x), F.lit("</m:t></m:r>"))
    tag = lambda t, *xs: F.concat(F.lit(f"<m:{t}>"), *xs, F.lit(f"</m:{t}>"))
    made = lambda *xs: O.omml_to_latex(F.concat(F.lit(f'<m:oMath xmlns:m="{D.NS["m"]}">'), *xs, F.lit("</m:oMath>")))
    sign = F.lit('<m:naryPr><m:chr m:val="∫"/></m:naryPr>')
    return spread(table(spark, sf_dir, "lineitem"), LIGHT_ROWS).select(
        "l_orderkey", "l_linenumber",
        made(tag("f", tag("num", r(q)), tag("den", r(n)))).alias("fraction"),
        made(tag("sSup", tag("e", r(q)), tag("sup", r(n)))).alias("power"),
        made(tag("rad", tag("deg", r(n)), tag("e", r(q)))).alias("root"),
        made(tag("nary", sign, tag("sub", r("0")), tag("sup", r(q)), tag("e", r("x≤%")))).alias("integral"),
        made(tag("func", tag("fName", r("sin")), tag("e", r(q)))).alias("sine"),
        made(tag("eqArr", tag("e", r("a")), tag("e", r(q)))).alias("lines"),
    )


_RUNS = "z * (s_suppkey % 3 + s_suppkey % 4 + (s_suppkey % 4 < 2)::BIGINT)"


@query(
    f"""SELECT s_suppkey, coalesce((SELECT string_agg(printf('⟦MT:%03d⟧', n), '' ORDER BY n) FROM range(1, {_RUNS} + 1) r(n)), '') AS marks, {_RUNS} AS formulas, z * (s_suppkey % 3 + s_suppkey % 4) AS converted, 0::BIGINT AS math_left,
    ({_RUNS} = 0)::BIGINT AS changed_more, true AS same_parts FROM (SELECT *, CASE WHEN s_suppkey % 7 = 6 THEN 0 ELSE 1 END AS z FROM supplier)"""
)
def docx_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written again with marks for formulas: the marks, what is left, and whether all other parts kept their bytes."""
    made = R.with_marks(sample(spark, sf_dir), "s_suppkey")
    return _compared(spark, sf_dir, made, "marks", r"\A⟦MT:[0-9]+⟧\z").withColumn("converted", F.col("converted").cast("long"))


@query(
    """SELECT s_suppkey, repeat('$$x$$', (z * (s_suppkey % 3))::INTEGER) || repeat('$y$', (z * (s_suppkey % 4))::INTEGER) AS texts, z * (s_suppkey % 3 + s_suppkey % 4) AS formulas, z * (s_suppkey % 3 + s_suppkey % 4) AS converted, 0::BIGINT AS math_left,
    (z * (s_suppkey % 3 + s_suppkey % 4) = 0)::BIGINT AS changed_more, true AS same_parts FROM (SELECT *, CASE WHEN s_suppkey % 7 = 6 THEN 0 ELSE 1 END AS z FROM supplier)"""
)
def docx_inline_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written again with LaTeX in the text."""
    return _compared(spark, sf_dir, R.with_latex(sample(spark, sf_dir), "s_suppkey"), "texts", r"\A\$.*\$\z")


def _compared(spark: SparkSession, sf_dir: str, made: DataFrame, name: str, pattern: str) -> DataFrame:
    """``changed_more``: 1 where the document kept its bytes though it was to change, or changed though it was not."""
    old, new = D.parts(sample(spark, sf_dir), "s_suppkey"), D.parts(made, "s_suppkey")
    both = old.select("s_suppkey", "part", F.sha1("data").alias("a")).join(new.select("s_suppkey", "part", F.sha1("data").alias("b")), ["s_suppkey", "part"], "full")
    same, body = F.col("a").eqNullSafe(F.col("b")), F.col("part") == "word/document.xml"
    kept = both.groupBy("s_suppkey").agg(F.bool_and(same | body).alias("same_parts"), F.count_if(same & body).alias("changed_more"))
    nodes = D.nodes(new.where(F.col("part") == "word/document.xml"), "s_suppkey")
    hit = F.when(F.col("text").rlike(pattern), F.struct("node_id", "text"))
    left = nodes.groupBy("s_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(hit)), lambda x: x["text"]), "").alias(name), F.count_if(F.col("local").isin("oMath", "oMathPara")).alias("math_left"))
    counts = made.select("s_suppkey", F.size("formulas").cast("long").alias("formulas"), F.size(F.filter("formulas", lambda f: f["latex"].isNotNull())).cast("long").alias("converted"))
    out = counts.join(kept, "s_suppkey").join(left, "s_suppkey", "left")
    return out.select("s_suppkey", F.coalesce(name, F.lit("")).alias(name), "formulas", "converted", F.coalesce("math_left", F.lit(0).cast("long")).alias("math_left"), "changed_more", "same_parts")
