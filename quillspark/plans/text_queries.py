"""Queries over text columns: Markdown, HTML, LaTeX, shapes, file names; with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import latex as X
from ..functions import markdown as M
from ..functions import units as U
from ..sources.tables import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


WS = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
JS = r"[\s\x{b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def sql_chain(expr: str, *rules: tuple[str, str, str]) -> str:
    """Nested ``regexp_replace`` (with its flags) or ``replace`` (flags 'lit') around ``expr``."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    for pattern, new, flags in rules:
        new = " || chr(10) || ".join(q(p) for p in new.split("\n"))
        if flags == "lit":
            old = " || chr(10) || ".join(q(p) for p in pattern.split("\n"))
            expr = f"replace({expr}, {old}, {new})"
        else:
            expr = f"regexp_replace({expr}, {q(pattern)}, {new}, {q(flags)})"
    return expr


POST = [
    ("\n", "\n", "lit"),
    (r"[ \t]+(\n|\z)", r"\1", "g"),
    (rf"(?m)^(#{{1,6}})([^#{WS[1:-1]}])", r"\1 \2", "g"),
    (r"([^\n])\n(#{1,6} )", "\\1\n\n\\2", "g"),
    (r"(#{1,6} [^\n]+)\n([^\n#])", "\\1\n\n\\2", "g"),
    (r"([^\n])\n(!\[[^\]]*\]\([^)]+\))", "\\1\n\n\\2", "g"),
    (r"(!\[[^\]]*\]\([^)]+\))\n([^\n])", "\\1\n\n\\2", "g"),
    (r"\n{3,}", "\n\n", "g"),
    (r"\$", "$", "lit"),
    (rf"\$\${WS}*\n{WS}*", "$$\n", "g"),
    (rf"{WS}*\n{WS}*\$\$", "\n$$", "g"),
]
STRIP = (rf"\A{WS}+|{WS}+\z", "", "g")
JSTRIP = (rf"\A{JS}+|{JS}+\z", "", "g")


def sql_post(expr: str, *extra: tuple[str, str, str]) -> str:
    expr = f"replace(replace({expr}, chr(13)||chr(10), chr(10)), chr(13), chr(10))"
    return sql_chain(expr, *POST[1:], *extra, STRIP) + " || chr(10)"


HTML = [
    *[(rf"(?is)<h{n}[^>]*>(.*?)</h{n}>", "\n\n" + "#" * n + " \\1\n\n", "g") for n in range(6, 0, -1)],
    (rf"(?i)<br{WS}*/?>", "\n", "g"),
    (rf"(?i)</p>{WS}*<p[^>]*>", "\n\n", "g"),
    ("(?i)<p[^>]*>", "\n\n", "g"),
    ("(?i)</p>", "\n\n", "g"),
    ("(?is)<strong[^>]*>(.*?)</strong>", r"**\1**", "g"),
    ("(?is)<b[^>]*>(.*?)</b>", r"**\1**", "g"),
    ("(?is)<em[^>]*>(.*?)</em>", r"*\1*", "g"),
    ("(?is)<i[^>]*>(.*?)</i>", r"*\1*", "g"),
    ('(?i)<img[^>]*src="([^"]+)"[^>]*alt="([^"]*)"[^>]*/?>', r"![\2](\1)", "g"),
    ('(?i)<img[^>]*alt="([^"]*)"[^>]*src="([^"]+)"[^>]*/?>', r"![\1](\2)", "g"),
    ('(?i)<img[^>]*src="([^"]+)"[^>]*/?>', r"![](\1)", "g"),
    ("(?i)<li[^>]*>", "\n- ", "g"),
    ("(?i)</li>", "", "g"),
    ("(?i)</?ul[^>]*>", "\n", "g"),
    ("(?i)</?ol[^>]*>", "\n", "g"),
    ('(?is)<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>', r"[\2](\1)", "g"),
    (rf"(?i)<hr{WS}*/?>", "\n\n---\n\n", "g"),
    ("<[^>]+>", "", "g"),
]
ENTITIES = [("&nbsp;", " ", "lit"), ("&lt;", "<", "lit"), ("&gt;", ">", "lit"), ("&amp;", "&", "lit"), ("&quot;", '"', "lit")]


@query(f"SELECT page_id, {sql_post(sql_chain('html', *HTML, *ENTITIES))} AS md FROM pages")
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: web pages to normalised Markdown, one projection over the scan."""
    pages = spread(table(spark, sf_dir, "pages"))
    return pages.select("page_id", M.postprocess(M.html_to_markdown(F.col("html"))).alias("md"))


@query(f"SELECT doc_id, {sql_post('text')} AS md FROM documents")
def postprocess_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", M.postprocess(F.col("text")).alias("md"))


NOTES = "'#' || lang || chr(13)||chr(10) || '  ' || text || '[^1] ' || chr(10)||chr(10)||chr(10)||chr(10) || '[^1]: ' || source || '  ' || chr(10) || '![a](b.png)' || chr(10) || 'C# x' || chr(10) || 'y' || chr(92) || '$'"


def noted() -> Column:
    n = F.lit("\n")
    return F.concat(F.lit("#"), "lang", F.lit("\r\n  "), "text", F.lit("[^1] \n\n\n\n[^1]: "), "source", F.lit("  \n![a](b.png)\nC# x"), n, F.lit("y\\$"))


@query(f"SELECT doc_id, {sql_post(NOTES, (r'\[\^[^\]]+\]', '', 'g'), (r'(?m)^\[\^[^\]]+\]:[^\n]*$', '', 'g'))} AS md FROM documents")
def postprocess_no_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", M.postprocess(noted(), keep_footnotes=False).alias("md"))


@query(f"SELECT doc_id, {sql_post(NOTES)} AS md FROM documents")
def postprocess_headings_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", M.postprocess(noted()).alias("md"))


def _each(spark: SparkSession, sf_dir: str, pattern: str, group: int, name: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(group))).alias("ord", name))
    return found.select("page_id", F.col("ord").cast("long").alias("ord"), M.strip_tags(F.col(name)).alias(name))


def _each_sql(pattern: str, group: int, name: str) -> str:
    hits = f"regexp_extract_all(html, '{pattern}', {group})"
    return f"SELECT page_id, i - 1 AS ord, regexp_replace(l[i], '<[^>]+>', '', 'g') AS {name} FROM (SELECT page_id, {hits} AS l, unnest(generate_series(1, len({hits}))) AS i FROM pages)"


@query(_each_sql("(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", 1, "heading"))
def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, "(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", 1, "heading")


@query(_each_sql('(?is)<a[^>]*href="([^"]+)"[^>]*>.*?</a>', 1, "href"))
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, '(?is)<a[^>]*href="([^"]+)"[^>]*>.*?</a>', 1, "href")


@query(_each_sql("(?is)<li[^>]*>(.*?)</li>", 1, "item"))
def html_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, "(?is)<li[^>]*>(.*?)</li>", 1, "item")


PLAIN = [
    ("(?i)<img[^>]*>", "[图]", "g"), ('(?is)<span[^>]*class="katex.*?</span>', "[公式]", "g"), ("<[^>]+>", "", "g"),
    ("&nbsp;", " ", "lit"), ("&lt;", "<", "lit"), ("&gt;", ">", "lit"), ("&amp;", "&", "lit"), (f"{JS}+", " ", "g"), JSTRIP,
]


@query(f"SELECT page_id, substring({sql_chain('html', *PLAIN)}, 1, 200) AS preview FROM pages")
def strip_tags_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.substring(M.plain_text(F.col("html")), 1, 200).alias("preview"))


ESC4 = [("&", "&amp;", "lit"), ("<", "&lt;", "lit"), (">", "&gt;", "lit"), ('"', "&quot;", "lit")]


@query(f"SELECT page_id, {sql_chain('html', *ESC4)} AS escaped4, {sql_chain('html', *ESC4[:3])} AS escaped3 FROM pages")
def escape_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", M.escape_html(h).alias("escaped4"), M.escape_html(h, quotes=False).alias("escaped3"))


DECODE = [(f"(?i){a}", b, "g") for a, b in (("&amp;", "&"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&apos;", "'"))]


@query(f"SELECT page_id, {sql_chain('html', *DECODE)} AS decoded, {sql_chain(chr(39) + '&amp;lt;&#39;' + chr(39) + ' || url', *DECODE)} AS twice FROM pages")
def decode_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", X.decode_entities(F.col("html")).alias("decoded"), X.decode_entities(F.concat(F.lit("&amp;lt;&#39;"), "url")).alias("twice"))


MESSY = r"'1\. <span x>' || text || '</span> A\. b\、 \$x\$ \\(y\\) \_\_\_\_ z\_ ＄ &amp;amp; ' || source"
UNESCAPE = [
    ("＄", "$", "lit"), *DECODE, ("(?i)</?(?:span|div|p|font|em|strong|i|b|u)[^>]*>", "", "g"),
    (r"([A-Da-d])\\([.．、])", r"\1\2", "g"), (r"([0-9]+)\\([.．])", r"\1\2", "g"), (r"\$", "$", "lit"),
    (r"\\\\([()\[\]])", r"\\\1", "g"), (r"\_", "_", "lit"),
]


@query(f"SELECT doc_id, {sql_chain(MESSY, *UNESCAPE)} AS clean FROM documents")
def unescape_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    messy = F.concat(F.lit(r"1\. <span x>"), "text", F.lit(r"</span> A\. b\、 \$x\$ \\(y\\) \_\_\_\_ z\_ ＄ &amp;amp; "), "source")
    return spread(table(spark, sf_dir, "documents")).select("doc_id", X.unescape_markdown(messy).alias("clean"))


@query(
    r"""SELECT p_partkey, '\log_{{' || p_size || '}} x{c} \begin{array}{l}a\end{array} \sqrt{b} \pi ' || p_name || '\log ' AS tex,
    '\begin{array}{l}\log_{{' || p_size || '}} \log  \pi \sqrt{x}' AS decoded FROM part"""
)
def word_tex_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = r"{ \rm{ l } }{ \rm{ o } }{ \rm{ g } }"
    messy = F.concat(F.lit(log + "_{ "), F.col("p_size").cast("string"), F.lit(r" } x{*{20}{c}} \begin{array}{}a\end{array} \sqrt [ ] {b} { \rm{ \pi } } "), "p_name", F.lit(r"{\rm{lo}}{\rm{g}} \left\{ \right."))
    bare = F.concat(F.lit(r"\begin{array} { }" + log + "_{ "), F.col("p_size").cast("string"), F.lit(" } " + log + r"  {\rm{\pi}} \sqrt[]{x}" + "\x01"))
    return table(spark, sf_dir, "part").select("p_partkey", X.word_artifacts(messy).alias("tex"), X.clean_decoded(bare).alias("decoded"))


SYM_SQL = sql_chain("'x≤y≠π√' || p_name || '→∞·'", *[(a, b, "lit") for a, b in X.SYMBOLS.items()])


@query(f"SELECT p_partkey, {SYM_SQL} AS tex FROM part")
def unicode_to_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.unicode_to_latex(F.concat(F.lit("x≤y≠π√"), "p_name", F.lit("→∞·"))).alias("tex"))


@query("SELECT doc_id, text || '' || source AS safe FROM documents")
def xml_safe_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.concat(F.lit("\x01\x0b"), "text", F.lit("\x1f\x7f￿"), "source", F.lit("﷐\x86"))
    return table(spark, sf_dir, "documents").select("doc_id", X.xml_safe(dirty).alias("safe"))


@query(
    r"""SELECT doc_id, len(regexp_extract_all(t, '(?s)\\\[.+?\\\]|\$\$[^$]+\$\$'))::BIGINT AS display,
    len(regexp_extract_all(t, '\\(frac|dfrac|sqrt|sum|int|alpha|beta|theta|cdot|times)\b'))::BIGINT AS commands,
    ((length(t) - length(replace(t, 'TOC ', ''))) // 4)::BIGINT AS toc
    FROM (SELECT doc_id, '$$a$$ \[b\] \frac{1}{2}\alpha TOC ' || text || '$$' || source || '$$\sqrt' AS t FROM documents)"""
)
def latex_trace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit(r"$$a$$ \[b\] \frac{1}{2}\alpha TOC "), "text", F.lit("$$"), "source", F.lit(r"$$\sqrt"))
    docs = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    toc = ((F.length("t") - F.length(F.replace("t", F.lit("TOC "), F.lit("")))) / 4).cast("long")
    return docs.select("doc_id", X.count_of(F.col("t"), r"(?s)\\\[.+?\\\]|\$\$[^$]+\$\$").alias("display"), X.count_of(F.col("t"), r"\\(frac|dfrac|sqrt|sum|int|alpha|beta|theta|cdot|times)\b").alias("commands"), toc.alias("toc"))


LATEX_LIKE = r"regexp_matches(t, '\\(?:begin|end|left|right|frac|dfrac|sqrt|mathrm|mathbf|rm|array|cases|log)') OR (contains(t, '\\') AND regexp_matches(t, '[{}^_]')) OR len(regexp_extract_all(t, '\\[a-zA-Z]+')) >= 2"


@query(f"SELECT p_partkey, {LATEX_LIKE} AS latex_like FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN '\\frac' || p_name WHEN 2 THEN '\\a \\b' ELSE p_name || '\\\\ x_1' END AS t FROM part)")
def looks_like_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    t = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.lit(r"\frac"), "p_name")).when(k == 2, F.lit(r"\a \b")).otherwise(F.concat("p_name", F.lit(r"\\ x_1")))
    return table(spark, sf_dir, "part").select("p_partkey", X.latex_like(t).alias("latex_like"))


@query("SELECT sha1(text) AS sha1, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def content_sha1_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("sha1"))
    return docs.groupBy("sha1").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


EXT = r"lower(regexp_extract(regexp_extract(url, '[^/]*$'), '.(\.[^.]*)$', 1))"


@query(f"SELECT CASE WHEN e = '' THEN '(none)' ELSE e END AS ext, count(*) AS n FROM (SELECT {EXT} AS e FROM pages) GROUP BY 1")
def ext_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.lower(F.regexp_extract(F.element_at(F.split("url", "/", -1), -1), r".(\.[^.]*)\z", 1))
    kind = F.when(ext == "", "(none)").otherwise(ext)
    return table(spark, sf_dir, "pages").groupBy(kind.alias("ext")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext")


UNITS = "CASE p_size % 5 WHEN 0 THEN 'pt' WHEN 1 THEN 'px' WHEN 2 THEN 'in' WHEN 3 THEN 'cm' ELSE 'mm' END"
TO_PT = "CASE p_size % 5 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size * 72.0::DOUBLE / 96.0::DOUBLE WHEN 2 THEN p_size * 72.0::DOUBLE WHEN 3 THEN p_size * 72.0::DOUBLE / 2.54::DOUBLE ELSE p_size * 72.0::DOUBLE / 25.4::DOUBLE END"


@query(f"SELECT p_partkey, greatest(1, round_even({TO_PT} * 96.0::DOUBLE / 72.0::DOUBLE * 2.0::DOUBLE, 0))::BIGINT AS width_px, 27::BIGINT AS height_px FROM part")
def shape_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 5
    unit = F.element_at(F.array(*map(F.lit, ("pt", "px", "in", "cm", "mm"))), (k + 1).cast("int"))
    style = F.concat(F.lit("Height: 10.25PT;margin:0;width:"), F.col("p_size").cast("string"), unit)
    width, height = U.shape_points(style)
    return table(spark, sf_dir, "part").select("p_partkey", U.points_to_pixels(width).alias("width_px"), U.points_to_pixels(height).alias("height_px"))


@query("SELECT p_partkey, 'data:image/png;base64,' || base64(encode(p_name || p_type || p_brand || p_name || p_type)) AS url FROM part")
def data_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.encode(F.concat("p_name", "p_type", "p_brand", "p_name", "p_type"), "UTF-8")
    return table(spark, sf_dir, "part").select("p_partkey", U.data_url(F.lit("image/png"), body).alias("url"))


@query("SELECT o_custkey, string_agg('===== 公式 ' || i || ' =====' || chr(10) || 'LaTeX:' || chr(10) || '$' || o_orderkey || '$' || chr(10), chr(10) ORDER BY i) AS listing FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) GROUP BY 1")
def formula_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    return held.select("o_custkey", X.formula_listing(F.transform("keys", lambda k: k.cast("string"))).alias("listing"))


@query("""SELECT o_custkey, '{"formulas":' || count(*) || ',"status":"' || max(o_orderstatus) || '"}' AS meta FROM orders GROUP BY 1""")
def meta_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("formulas"), F.max("o_orderstatus").alias("status"))
    return counts.select("o_custkey", F.to_json(F.struct("formulas", "status")).alias("meta"))


@query("SELECT doc_id, CASE WHEN length(text) > 4000 THEN substring(text, 1, 4000) || chr(10) || '…(truncated)' ELSE text END AS preview, chr(65279) || text AS download, replace(text, ' ', '    ') AS tabs FROM documents")
def preview_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", M.preview(t).alias("preview"), M.with_bom(t).alias("download"), M.expand_tabs(F.translate(t, " ", "\t")).alias("tabs"))


@query("SELECT c_custkey, substring(regexp_replace(c_name || '/' || c_mktsegment || ' 题 ' || c_name || c_mktsegment, '[^A-Za-z0-9_-]', '', 'g'), 1, 40) AS job FROM customer")
def job_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("c_name", F.lit("/"), "c_mktsegment", F.lit(" 题 "), "c_name", "c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", M.job_id(name).alias("job"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.emf' WHEN 2 THEN '.wmf' ELSE '.png' END AS ext FROM part")
def mime_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("image/jpeg", "application/x-emf", "application/x-msmetafile", "image/unheard-of")))
    return table(spark, sf_dir, "part").select("p_partkey", M.extension_of(F.element_at(kinds, (F.col("p_size") % 4 + 1).cast("int"))).alias("ext"))


@query("SELECT c_custkey, chr(10)||chr(10) || '| Name | ' || 'Seg' || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c_name || ' | ' || c_mktsegment || ' |' || chr(10)||chr(10) || 'x' AS md FROM customer")
def table_to_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit("<TABLE border=1><tr><th><b>Name</b></th><th>\nSeg </th></tr><tr></tr><tr><td>"), "c_name", F.lit("</td><td> "), "c_mktsegment", F.lit("</td></tr></table>x"))
    return table(spark, sf_dir, "customer").select("c_custkey", M.tables_to_pipe(html).alias("md"))


@query("SELECT c_custkey, '<div class=\"md-table-wrap\"><table><thead><tr><th>a&lt;</th><th>b</th></tr></thead><tbody><tr><td>' || c_name || '</td><td></td></tr><tr><td>' || c_mktsegment || '</td><td>2</td></tr></tbody></table></div>' AS html, 'a|b<br/>' || c_name AS bad FROM customer")
def pipe_to_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.concat(F.lit("\n| a< | b |\n|---|:-:|\n| "), "c_name", F.lit(" |\n| "), "c_mktsegment", F.lit(" | 2 | 3 |\n"))
    return table(spark, sf_dir, "customer").select("c_custkey", M.render_pipe_table(block).alias("html"), M.render_pipe_table(F.concat(F.lit("a|b\n"), "c_name")).alias("bad"))


@query("SELECT s_suppkey, 'img/' || s_name || ' x.png' AS target, lower('img/' || s_name || '.png') AS key, lower(s_name || '.png') AS base, '<img src=\"a&amp;b\" alt=\"题目配图\" loading=\"lazy\" />' AS tag FROM supplier")
def image_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(' "img/'), "s_name", F.lit(" x.png\" 'a title' "))
    path = F.concat(F.lit(" .\\img\\"), "s_name", F.lit(".PNG "))
    suppliers = table(spark, sf_dir, "supplier")
    return suppliers.select("s_suppkey", M.image_target(raw).alias("target"), M.path_key(path).alias("key"), M.base_key(path).alias("base"), M.image_tag(F.lit("a&b"), F.lit("")).alias("tag"))
