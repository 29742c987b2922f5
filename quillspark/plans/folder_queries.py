"""Queries over folders of papers: pictures found, lost or absent, and folders without a paper."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import folders

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = k.cast("string")
    text = F.concat(F.lit("1. a"), name, F.lit(" ![x](img/p"), name, F.lit(".png 'title')\n【答案】b\n2. c"))
    item = lambda path, content, here: F.when(here, F.struct(path.alias("path"), content.alias("content")))
    items = F.filter(
        F.array(
            item(F.concat(F.lit("f/exam"), name, F.lit(".md")), text, k % 5 != 4), item(F.lit("f/deep/a.md"), F.lit("9. no"), k % 5 != 4), item(F.concat(F.lit("f/pics/P"), name, F.lit(".PNG")), F.lit("png"), k % 3 == 0),
            item(F.lit("f/z.png"), F.lit("z"), k % 3 == 2), item(F.lit("f/notes.txt"), F.lit("1. x"), F.lit(True)),
        ),
        lambda x: x.isNotNull(),
    )
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(items).alias("i"))
    return rows.select("s_suppkey", "i.path", F.lit(None).cast("string").alias("type"), F.encode("i.content", "UTF-8").alias("content"))


MISSING = "'有 1 张图片未加载成功（多为相对路径）。请在选择文件时同时选中 .md 与对应的 .jpg/.png 等图片文件。例如：img/p' || s_suppkey || '.png'"


@query(
    f"""SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 4 THEN '{folders.NO_PAPER}' ELSE concat_ws('|', '成功从 Markdown 识别 2 道题。', '第 2 题未找到【答案】/【分析】/【详解】标记。', '其中 1 题含图片引用。' || CASE s_suppkey % 3 WHEN 0 THEN '已匹配本地图片 26 个。' WHEN 2 THEN '已匹配本地图片 26 个。' ELSE '' END,
    CASE WHEN s_suppkey % 3 <> 0 THEN {MISSING} END, CASE WHEN s_suppkey % 3 <> 1 THEN '{folders.LOADED[0]}1{folders.LOADED[1]}' ELSE '{folders.LOST[0]}1{folders.LOST[1]}' END) END AS notices FROM supplier"""
)
def folder_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders.parse_folders(_files(spark, sf_dir), "s_suppkey").select("s_suppkey", F.array_join(F.transform("notices", lambda n: n["text"]), "|").alias("notices"))


@query(
    """SELECT s_suppkey, u."index", CASE u."index" WHEN 1 THEN 'a' || s_suppkey || ' <img src="' || CASE WHEN s_suppkey % 3 = 0 THEN 'data:image/png;base64,cG5n' ELSE 'img/p' || s_suppkey || '.png' END || '" alt="x" loading="lazy" />' ELSE 'c' END AS stem_html,
    CASE u."index" WHEN 1 THEN 'b' ELSE '' END AS answer_html FROM supplier, (SELECT unnest([1, 2])::BIGINT AS "index") u WHERE s_suppkey % 5 <> 4"""
)
def folder_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = folders.parse_folders(_files(spark, sf_dir), "s_suppkey").select("s_suppkey", F.explode("questions").alias("q"))
    return rows.select("s_suppkey", "q.index", "q.stem_html", "q.answer_html")


@query(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 4 THEN 0 ELSE 2 END AS questions, CASE WHEN s_suppkey % 5 = 4 THEN 1 ELSE 4 + (s_suppkey % 3 <> 0)::INTEGER END AS warnings,
    CASE WHEN s_suppkey % 5 = 4 OR s_suppkey % 3 = 0 THEN NULL ELSE 'img/p' || s_suppkey || '.png' END AS missing FROM supplier"""
)
def folder_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = folders.as_json(folders.parse_folders(_files(spark, sf_dir), "s_suppkey"), "s_suppkey")
    got = lambda path: F.get_json_object("json", path)
    return text.select("s_suppkey", F.json_array_length(got("$.questions")).alias("questions"), F.json_array_length(got("$.warnings")).alias("warnings"), got("$.unresolvedImages[0]").alias("missing"))
