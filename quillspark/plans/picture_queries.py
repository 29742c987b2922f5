"""Queries over pictures, embedded objects and the web pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import web as W
from ..operators import pictures as P
from ..sources import docx as D
from ..sources.tables import TEXTS, spread, table
from .docx_queries import body, files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = body(
        "<w:p><w:r><w:object><v:shape style='width:", F.col("s_suppkey"), "pt;height:12pt'><v:imagedata r:id='r1'/></v:shape><o:OLEObject ProgID='Equation.3' r:id='r3'/></w:object></w:r></w:p>",
        "<wp:anchor><wp:extent cx='12700' cy='25400'/><a:blip r:embed='r2'/></wp:anchor><wp:inline><wp:extent cx='127000' cy='254000'/><a:blip r:embed='r2'/></wp:inline>",
    )
    rel = lambda i, t: f'<Relationship Id="{i}" Target="{t}"/>'
    rels = f'<Relationships xmlns="{D.NS["rel"]}">{rel("r1", "media/z.wmf")}{rel("r2", "media/p.JPEG")}{rel("r3", "embeddings/o.bin")}</Relationships>'
    members = {"word/document.xml": doc, "word/_rels/document.xml.rels": rels, "word/media/z.wmf": "\x01\x00\x00\x00z", "word/media/p.JPEG": "jpeg", "word/media/none": "n", "word/embeddings/o.bin": F.concat(F.lit("ole"), "s_name")}
    return files(table(spark, sf_dir, "supplier"), "s_suppkey", members)


def _tables(spark: SparkSession, sf_dir: str, rule: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    parts = D.parts(_files(spark, sf_dir), "s_suppkey")
    nodes = D.nodes(parts.where(F.col("part").rlike(r"\.(xml|rels)\z")), "s_suppkey")
    return parts, nodes.where("part = 'word/document.xml'"), D.relationships(nodes, rule, "s_suppkey")


@query("SELECT s_suppkey, u.* FROM supplier, (SELECT * FROM (VALUES ('001', 'none', 'image001.bin', NULL), ('002', 'p.JPEG', 'image002.jpg', NULL), ('003', 'z.wmf', 'image003.wmf', 'emf')) v(image_id, original, name, vector)) u")
def image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.image_names(D.parts(_files(spark, sf_dir), "s_suppkey"), "s_suppkey")


@query("SELECT s_suppkey, sha1('jpeg') AS sha1, 3::BIGINT AS width_px, 5::BIGINT AS height_px FROM supplier UNION ALL SELECT s_suppkey, sha1(chr(1) || chr(0) || chr(0) || chr(0) || 'z'), greatest(1, round_even(s_suppkey * 96.0::DOUBLE / 72.0::DOUBLE * 2.0::DOUBLE, 0))::BIGINT, 32 FROM supplier WHERE s_suppkey > 0")
def image_size_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, nodes, rels = _tables(spark, sf_dir, "image")
    return P.layout_sizes(nodes, rels, parts, "s_suppkey")


@query("SELECT s_suppkey, 'r3' AS rid, 'word/embeddings/o.bin' AS part, 'ole' || s_name AS data, 5::BIGINT AS parts_left, 2::BIGINT AS rels_left FROM supplier")
def ole_rel_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, nodes, rels = _tables(spark, sf_dir, "raw")
    found = P.ole_parts(nodes, rels, parts, "s_suppkey")
    kept, left = P.without_objects(parts, rels, found, "s_suppkey")
    counts = kept.groupBy("s_suppkey").agg(F.count("*").alias("parts_left")).join(left.groupBy("s_suppkey").agg(F.count("*").alias("rels_left")), "s_suppkey")
    return found.select("s_suppkey", "rid", "part", F.decode("data", "UTF-8").alias("data")).join(counts, "s_suppkey")


NL = "chr(10)"


@query(f"SELECT s_suppkey, '1. q' || s_suppkey || {NL} || 'A. \\$\\frac{{1}}{{2}}$' || {NL} || 'B. x ' || {NL} || '【答案】A' || {NL}||{NL} || '![配图](p.png)' || {NL}||{NL} || '2、z' || {NL} AS md FROM supplier")
def web_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit("<p>1. q"), F.col("s_suppkey").cast("string"), F.lit(" A. \\frac { 1 } { 2 }  B. x 【答案】A</p><img alt='' src=''/><img src=\"p.png\"/><p>2、z</p>"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", W.web_markdown(html).alias("md"))


#: HTML and the Markdown of the web path, with № for a number and ¶ for a line end.
STRUCTURES = [
    ("<h1>T №</h1><p>a <b>bold </b>t<i>x</i><br>next №</p>", "# T №¶¶a **bold** t*x*¶next №"),
    ("<ul><li>one №</li><li>two<ul><li>in</li><li>in №</li></ul></li></ul><p>z</p>", "-   one №¶-   two¶    -   in¶    -   in №¶¶z"),
    ("<p>x</p><ol start='4'><li>c</li><li><p>d №</p><p>e</p></li><li>f</li></ol>", "x¶¶4.  c¶¶5.  d №¶¶    e¶¶6.  f"),
    ("<blockquote><p>q №</p><blockquote>w</blockquote></blockquote>", "> q №¶>¶> > w"),
    ("<pre><code class='language-py'>x = №¶  y*z</code></pre><p>in <code>a`№_b</code></p>", "```py¶x = №¶  y*z¶```¶¶in ``a`№_b``"),
    ("<p>$<i>a</i>_№$ and a_b * c [d]</p><p>$$x¶y$$</p>", "$<i>a</i>_№$ and a\\_b \\* c \\[d\\]¶¶$$x¶y$$"),
    ("<p>+ №</p><p>- x</p><p>&gt; y</p><p># z</p><p>=== w</p>", "\\+ №¶¶\\- x¶¶\\> y¶¶\\# z¶¶\\=== w"),
    ("<p>see <a href='u(№)' title='t'>l</a><img alt='n' src='x№.png'>end</p><hr>", "see [l](u\\(№\\) \"t\")¶¶![n](x№.png)¶¶end¶¶* * *"),
    ("<table><tr><td>a №</td><td><p>b</p></td></tr></table><p></p><div> <span> s </span>t</div>", "a №¶¶b¶¶s t"),
    ("<p>un<em>closed №<ul><li>a<li>b</ul>", "un*closed №*¶¶-   a¶-   b"),
    ("<!-- № --><script>no</script><p>&lt;x&gt; &amp;amp; &eacute;&nbsp;№</p>", "<x> &amp; é №"),
    ("", ""),
]
_WEB = ", ".join(f"({k}, '{md.replace(chr(39), chr(39) * 2)}')" for k, (_, md) in enumerate(STRUCTURES))


@query(f"SELECT c_custkey, u.k::INTEGER AS k, replace(replace(u.md, '№', (c_custkey % 97)::VARCHAR), '¶', chr(10)) || chr(10) AS md FROM customer, (SELECT * FROM (VALUES {_WEB}) v(k, md)) u")
def web_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, lists, quotes, code, formulas, escapes, links, tables and damage, with a number of the row in each."""
    filled = lambda x: F.replace(F.replace(F.lit(x), F.lit("№"), (F.col("c_custkey") % 97).cast("string")), F.lit("¶"), F.lit("\n"))
    made = [F.struct(F.lit(k).alias("k"), filled(x).alias("x")) for k, (x, _) in enumerate(STRUCTURES)]
    rows = spread(table(spark, sf_dir, "customer"), TEXTS).select("c_custkey", F.explode(F.array(*made)).alias("m"))
    return rows.select("c_custkey", "m.k", W.web_markdown(F.col("m.x")).alias("md"))



@query(
    """SELECT o_custkey, least(8, count(DISTINCT o_orderpriority || (o_orderkey % 4)) FILTER (o_orderstatus <> 'F' AND o_orderkey % 5 > 0))::BIGINT AS n FROM orders GROUP BY 1"""
)
def warning_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise, notes that are no warnings, repeats, and more than eight messages."""
    k = F.col("o_orderkey")
    told = F.when(F.col("o_orderstatus") == "F", F.lit("Unrecognised element: x")).otherwise(F.concat("o_orderpriority", (k % 4).cast("string")))
    message = F.struct(F.when(k % 5 == 0, "info").when(k % 2 == 0, "error").otherwise("warning").alias("type"), told.alias("message"))
    held = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(message)).alias("m"))
    return held.select("o_custkey", F.size(W.warnings(F.col("m"))).cast("long").alias("n"))


@query(
    """SELECT c_nationkey, path FROM (SELECT c_nationkey, path, row_number() OVER (PARTITION BY c_nationkey ORDER BY len(string_split(path, '/')), path) AS n FROM
    (SELECT c_nationkey, unnest(CASE WHEN c_nationkey % 3 = 0 THEN [c_name || '.txt'] ELSE [] END || CASE WHEN c_nationkey % 2 = 0 THEN ['a/' || c_name || '.MD'] ELSE [] END || ['a/b/' || c_name || '.markdown']) AS path FROM customer)) WHERE n = 1"""
)
def markdown_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least depth, then the first name; some by extension, some by type, and others no Markdown."""
    c, n = table(spark, sf_dir, "customer"), F.col("c_nationkey")
    item = lambda before, after, kind, here: F.when(here, F.struct(F.concat(F.lit(before), "c_name", F.lit(after)).alias("path"), F.lit(kind).alias("type")))
    items = F.array(item("", ".txt", "text/markdown", n % 3 == 0), item("a/", ".MD", None, n % 2 == 0), item("a/b/", ".markdown", None, F.lit(True)), item("", ".txt", "text/plain", F.lit(True)))
    files = c.select("c_nationkey", F.explode(F.filter(items, lambda x: x.isNotNull())).alias("i")).select("c_nationkey", "i.path", "i.type")
    return W.pick_markdown(files, ["c_nationkey"]).select("c_nationkey", "path")


@query("SELECT s_suppkey, 'x <img class=\"formula\" src=\"/files/j/assets/formula001.png\" alt=\"f\"> <img class=\"figure\" src=\"/files/j/assets/' || s_name || '\" alt=\"\">' AS html, true AS image FROM supplier")
def preview_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.concat(F.lit("x ![f](assets/formula001.png) ![](assets/"), "s_name", F.lit(")"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", W.tag_images(md, F.lit("j")).alias("html"), W.is_image(F.concat("s_name", F.lit(".WebP")), F.lit(None).cast("string")).alias("image"))


@query("SELECT s_suppkey, '<math>' || s_name || '</math>' AS mathml FROM supplier")
def mathml_raw_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.mtef import ole_formula

    blob = F.encode(F.concat(F.lit("junk\x00 <math>"), "s_name", F.lit("</math> tail")), "UTF-8")
    return table(spark, sf_dir, "supplier").select("s_suppkey", ole_formula(blob).alias("f")).select("s_suppkey", F.col("f.mathml").alias("mathml"))


#: Markdown and its preview, with № for a number and ¶ for a line end.
PREVIEWS = [
    ("# T *x* №¶¶a **b** `c<d` №¶next & <b>y</b> 1 < 2", '<h1>T <em>x</em> №</h1>¶<p>a <strong>b</strong> <code>c&lt;d</code> №<br />¶next &amp; <b>y</b> 1 &lt; 2</p>'),
    ("- a №¶- b¶    - c¶    - d №¶¶1. x¶2. y", "<ul>¶<li>a №</li>¶<li>b<ul>¶<li>c</li>¶<li>d №</li>¶</ul>¶</li>¶</ul>¶<ol>¶<li>x</li>¶<li>y</li>¶</ol>"),
    ("3. a¶¶4. b №¶¶    more¶¶end", '<ol start="3">¶<li>¶<p>a</p>¶</li>¶<li>¶<p>b №</p>¶<p>more</p>¶</li>¶</ol>¶<p>end</p>'),
    ("> q №¶> w¶¶***¶¶```py¶x<№¶```", '<blockquote>¶<p>q №<br />¶w</p>¶</blockquote>¶<hr />¶<pre><code class="language-py">x&lt;№¶</code></pre>'),
    ("| a | № |¶|:--|--:|¶| 1 | `x` |¶¶z", '<table>¶<thead>¶<tr>¶<th style="text-align: left;">a</th>¶<th style="text-align: right;">№</th>¶</tr>¶</thead>¶<tbody>¶<tr>¶<td style="text-align: left;">1</td>¶<td style="text-align: right;"><code>x</code></td>¶</tr>¶</tbody>¶</table>¶<p>z</p>'),
    ("![n](assets/formula№.png) ![f](assets/image№.png)", '<p><img class="formula" src="/files/j№/assets/formula№.png" alt="n"> <img class="figure" src="/files/j№/assets/image№.png" alt="f"></p>'),
    ("![a](x/glyph№.png) ![b](y/image№.png) ![c](z.png)", '<p><img class="formula" alt="a" src="x/glyph№.png" /> <img class="figure" alt="b" src="y/image№.png" /> <img alt="c" src="z.png" /></p>'),
    ("[l№](u 't') <http://a.b?c&d> snake_case_№ \\*n\\* $a_1$", '<p><a href="u" title="t">l№</a> <a href="http://a.b?c&amp;d">http://a.b?c&amp;d</a> snake_case_№ *n* $a_1$</p>'),
    ("<div>¶*№*¶</div>¶¶    code №¶    more", "<div>¶*№*¶</div>¶<pre><code>code №¶more¶</code></pre>"),
    ("", ""),
]
_PREVIEW = ", ".join(f"({k}, '{h.replace(chr(39), chr(39) * 2)}')" for k, (_, h) in enumerate(PREVIEWS))


@query(f"SELECT c_custkey, u.k::INTEGER AS k, replace(replace(u.h, '№', (c_custkey % 97)::VARCHAR), '¶', chr(10)) AS html FROM customer, (SELECT * FROM (VALUES {_PREVIEW}) v(k, h)) u")
def preview_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previews of every kind of block and mark, with a number of the row in each."""
    number = (F.col("c_custkey") % 97).cast("string")
    filled = lambda x: F.replace(F.replace(F.lit(x), F.lit("№"), number), F.lit("¶"), F.lit("\n"))
    made = [F.struct(F.lit(k).alias("k"), filled(x).alias("x")) for k, (x, _) in enumerate(PREVIEWS)]
    rows = spread(table(spark, sf_dir, "customer"), TEXTS).select("c_custkey", F.explode(F.array(*made)).alias("m"))
    return rows.select("c_custkey", "m.k", W.preview_html(F.col("m.x"), F.concat(F.lit("j"), number)).alias("html"))
