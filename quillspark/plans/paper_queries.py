"""Queries over exam papers, formulas and pictures: folds, windows and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paper as P
from ..operators import assets as A
from ..operators import formulas as O
from ..sources.tables import TEXTS, spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paper for each order: heads 1, 3, 2, 第3题, 3 with known sections."""
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    text = F.concat(
        F.lit("﻿机密 x\r\n1. stem"), k, F.lit("\n【答案】a"), k, F.lit("\n3. stray"), c, F.lit("\n## 2、second $x$ "), c,
        F.lit("\n【分析】b"), k, F.lit("【解析】more【详解】d"), k, F.lit("\n第 3 题 third ![i](p.png)\n3. again"), k,
    )
    return spread(table(spark, sf_dir, "orders"), TEXTS).select("o_orderkey", text.alias("paper"))


@query(
    """SELECT o_orderkey, u.q AS "index", CASE u.q WHEN 1 THEN 'stem' || o_orderkey WHEN 2 THEN 'second $x$ ' || o_custkey ELSE 'third ![i](p.png)' || chr(10) || '3. again' || o_orderkey END AS stem,
    CASE u.q WHEN 1 THEN 'a' || o_orderkey || chr(10) || '3. stray' || o_custkey ELSE '' END AS answer,
    CASE u.q WHEN 2 THEN 'b' || o_orderkey || chr(10) || 'more' ELSE '' END AS analysis, CASE u.q WHEN 2 THEN 'd' || o_orderkey ELSE '' END AS detail
    FROM orders, (SELECT unnest([1, 2, 3])::BIGINT AS q) u"""
)
def paper_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = papers(spark, sf_dir).select("o_orderkey", F.explode(P.questions(F.col("paper"))).alias("q"))
    return rows.select("o_orderkey", "q.index", "q.stem", "q.answer", "q.analysis", "q.detail")


@query("SELECT o_orderkey, u.q AS \"index\", CASE u.q WHEN 16 THEN repeat('前', 40) || chr(10)||chr(10) || 'x' || o_orderkey ELSE 'y' || chr(10) || '5. z' END AS stem FROM orders, (SELECT unnest([16, 17])::BIGINT AS q) u")
def paper_chain_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("前" * 40 + "\n16. x"), F.col("o_orderkey").cast("string"), F.lit("\n17、y\n5. z"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(P.questions(text)).alias("q"))
    return rows.select("o_orderkey", "q.index", "q.stem")


@query(
    """SELECT o_orderkey, u.i AS ord, u.level, u.text FROM orders, (SELECT * FROM (VALUES (0::BIGINT, 'ok', '成功从 Markdown 识别 3 道题。'), (1, 'tip', '第 3 题未找到【答案】/【分析】/【详解】标记。'),
    (2, 'ok', '其中 1 题含 LaTeX 公式，已用 KaTeX 渲染。'), (3, 'ok', '其中 1 题含图片引用。')) v(i, level, text)) u"""
)
def paper_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = papers(spark, sf_dir).withColumn("qs", P.questions(F.col("paper")))
    notes = found.select("o_orderkey", F.posexplode(P.notices(F.col("paper"), F.col("qs"))).alias("ord", "n"))
    return notes.select("o_orderkey", F.col("ord").cast("long").alias("ord"), "n.level", "n.text")


@query("SELECT o_orderkey, 's' || o_orderkey AS stem, 'a' || chr(10) || 'c' AS answer, '' AS analysis, o_orderstatus AS detail FROM orders")
def paper_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit(" s"), F.col("o_orderkey").cast("string"), F.lit(" 【答案】 【答案】a\n【分析】【详解】"), "o_orderstatus", F.lit("【答案】c"))
    return table(spark, sf_dir, "orders").select("o_orderkey", P.sections(body).alias("s")).select("o_orderkey", "s.*")


@query("SELECT o_custkey, o_orderkey, printf('%03d', row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END, o_orderkey)) AS formula_id FROM orders")
def formula_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return O.number(table(spark, sf_dir, "orders").withColumn("kind", kind), ["o_custkey"], ["kind", "o_orderkey"], "formula_id").select("o_custkey", "o_orderkey", "formula_id")


@query(
    """SELECT o_orderkey, 'see ' || CASE l_linenumber_max % 3 WHEN 0 THEN '$$' || q || '$$' WHEN 1 THEN '![001](image/f.png)' ELSE '`[公式 001 待处理]`' END || ' and ⟦MT:001⟧ and [FORMULA_9]' AS md
    FROM (SELECT l_orderkey AS o_orderkey, max(l_linenumber) AS l_linenumber_max, 'x^' || max(l_linenumber) AS q FROM lineitem GROUP BY 1)"""
)
def formula_substitute(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linenumber").alias("n"))
    docs = lines.select("o_orderkey", F.lit("see ⟦MT:001⟧ and ⟦MT:001⟧ and [FORMULA_9]").alias("md"))
    kind = F.col("n") % 3
    formulas = lines.select(
        "o_orderkey", F.lit("001").alias("formula_id"), F.when(kind == 0, F.concat(F.lit(" x^"), F.col("n").cast("string"))).alias("latex"), (kind == 0).alias("display"),
        F.when(kind == 1, F.lit("image/f.png")).alias("image_path"), F.lit("mathtype").alias("source"),
    )
    return O.substitute(docs, formulas, ["o_orderkey"], "md")


# Papers of which the odd ones have only half of their pictures; all papers name their pictures alike.
@query(
    """SELECT paper, nth, CASE WHEN p_size % 3 < 2 AND (paper % 2 = 0 OR nth % 2 = 0) THEN 'u' || p_partkey ELSE NULL END AS url,
    CASE p_size % 3 WHEN 0 THEN 'image/p' || nth || '.png' WHEN 1 THEN './x/y/P' || nth || '.PNG' ELSE 'gone' || nth || '.jpg' END AS src FROM (SELECT *, p_partkey % 500 AS paper, p_partkey // 500 AS nth FROM part)"""
)
def asset_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, assets = _assets(spark, sf_dir)
    return A.resolve(refs, assets, ["paper"]).select("paper", "nth", "src", "url")


def _assets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, n = F.col("p_partkey"), F.floor(F.col("p_partkey") / 500).cast("long")
    part = spread(table(spark, sf_dir, "part"), TEXTS).withColumns({"paper": k % 500, "nth": n})
    name, kind = F.col("nth").cast("string"), F.col("p_size") % 3
    src = F.when(kind == 0, F.concat(F.lit("image/p"), name, F.lit(".png"))).when(kind == 1, F.concat(F.lit("./x/y/P"), name, F.lit(".PNG"))).otherwise(F.concat(F.lit("gone"), name, F.lit(".jpg")))
    held = part.where((F.col("paper") % 2 == 0) | (F.col("nth") % 2 == 0))
    assets = held.select("paper", F.concat(F.lit("in\\sub/P"), name, F.lit(".png")).alias("path"), F.concat(F.lit("u"), k.cast("string")).alias("url"), k.alias("seq"))
    return part.select("paper", "nth", src.alias("src")), assets


@query(
    """SELECT DISTINCT paper, CASE p_size % 3 WHEN 0 THEN 'image/p' || nth || '.png' WHEN 1 THEN './x/y/P' || nth || '.PNG' ELSE 'gone' || nth || '.jpg' END AS src
    FROM (SELECT *, p_partkey % 500 AS paper, p_partkey // 500 AS nth FROM part) WHERE p_size % 3 = 2 OR NOT (paper % 2 = 0 OR nth % 2 = 0)"""
)
def asset_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, assets = _assets(spark, sf_dir)
    return A.unresolved(A.resolve(refs, assets, ["paper"]), ["paper"])


COMMON = "['image','images','img','imgs','media','assets','pic','pics','static','figures','figure']"


@query(
    f"""SELECT DISTINCT s_suppkey, k AS key FROM (SELECT s_suppkey, lower('a/b/' || s_name || '.png') AS n, lower(s_name || '.png') AS b FROM supplier) t,
    LATERAL (SELECT unnest(['a/b/' || b, './a/b/' || b, b, './' || b, 'b/' || b, './b/' || b] || list_transform({COMMON}, lambda d: d || '/' || b) || list_transform({COMMON}, lambda d: './' || d || '/' || b)) AS k) u"""
)
def asset_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("/a\\b/"), "s_name", F.lit(".PNG")).alias("path"))
    return suppliers.select("s_suppkey", F.explode(A.keys_of(F.col("path"))).alias("key"))


@query(
    """SELECT s_suppkey, '![a](image/image' || printf('%03d', s_suppkey) || '.png) ![f](image/formula001.png) ![z](zz.png) ![n](image/image' || printf('%03d', s_suppkey) || '.png)' AS md FROM supplier"""
)
def image_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.format_string("image%03d.png", "s_suppkey")
    docs = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("![a](media/"), F.upper(name), F.lit(") ![f](formula001.png) ![z](zz.png) ![n](Image"), F.col("s_suppkey").cast("string"), F.lit(".gif)")).alias("md"))
    images = table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name"), F.col("s_suppkey").alias("seq"))
    return A.rewrite_images(docs, images, ["s_suppkey"], "md", "image")


@query("SELECT c_nationkey AS doc, count(*) FILTER (c_mktsegment = 'BUILDING') AS display, count(*) FILTER (c_mktsegment = 'MACHINERY') AS inline, count(*) FILTER (c_mktsegment NOT IN ('BUILDING','MACHINERY')) AS other, CASE WHEN count(*) FILTER (c_mktsegment = 'BUILDING') > 0 THEN 'mathtype' WHEN count(*) FILTER (c_mktsegment = 'MACHINERY') > 0 THEN 'omml' ELSE 'none' END AS main FROM customer GROUP BY 1")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("c_mktsegment")
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("doc")).agg(
        F.count_if(s == "BUILDING").alias("display"), F.count_if(s == "MACHINERY").alias("inline"), F.count_if(~s.isin("BUILDING", "MACHINERY")).alias("other")
    )
    return counts.withColumn("main", F.when(F.col("display") > 0, "mathtype").when(F.col("inline") > 0, "omml").otherwise("none"))


PROG = "CASE event_type WHEN 'click' THEN 'Equation.DSMT4' WHEN 'view' THEN 'Equation.3' ELSE 'Excel.Sheet' END"


@query(
    f"""SELECT user_id, prog, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_id) AS rank FROM
    (SELECT user_id, {PROG} AS prog, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1, 2)"""
)
def progid_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    prog = F.when(e == "click", "Equation.DSMT4").when(e == "view", "Equation.3").otherwise("Excel.Sheet")
    counts = table(spark, sf_dir, "events").groupBy("user_id", prog.alias("prog")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "first_id"))
    return counts.select("user_id", "prog", "n", rank.cast("long").alias("rank"))


@query(
    """SELECT user_id, max(n) AS longest FROM (SELECT user_id, grp, count(*) FILTER (event_type = 'error') AS n FROM
    (SELECT user_id, event_type, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM events) GROUP BY 1, 2) GROUP BY 1"""
)
def empty_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("user_id"), "event_id", (F.col("event_type") == "error").alias("empty"))
    return O.longest_run(events, ["user_id"], ["event_id"], "empty", "longest")
