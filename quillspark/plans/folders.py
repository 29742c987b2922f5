"""Folders of exam papers: the Markdown file of each, its pictures as data URLs, questions and notices.

Pictures are found by joins within the folder; a paper's resolved references are one small map beside its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import units as U
from ..functions import web as W
from ..functions.regex import let, matches_of, rewrite_matches
from ..operators import assets as A
from ..sources.files import scan_files
from ..sources.tables import dealt
from .convert import parse_papers

IMAGE = r"!\[[^\]]*\]\([^)]+\)"
# Content types by extension, and the notices on a folder.
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml"}
NO_PAPER = "未找到 Markdown 文件。请选择含 .md 的试卷文件夹（需包含 image 子目录）。"
LOADED = ("已载入 ", " 张本地图片，并支持匹配 image/文件名.jpg 相对路径。")
LOST = ("有 ", " 处图片未加载（如 image/...）。请用「选择试卷文件夹」选中含 image 子目录的整夹；若 Markdown 已内嵌 data URL 配图则可忽略。")
NONE = "未载入任何图片文件。若配图在 image/ 目录，请用「选择整个试卷文件夹」导入。"


def scan_folders(spark: SparkSession, path: str, each: bool = True) -> DataFrame:
    """``doc_id, path, type, content`` of all files below a path; each folder in it is a paper, told by its name, and files in none are left out.

    Not ``each``: all that is below the path is one paper, told by the path's last segment.
    """
    files = scan_files(spark, path)
    cut = F.instr("path", "/")
    name = F.substring(F.col("path"), F.lit(1), cut - 1) if each else F.lit(path.rstrip("/").rpartition("/")[2])
    kept = files.where(cut > 0) if each else files
    return kept.select(name.alias("doc_id"), "path", F.lit(None).cast("string").alias("type"), "content")


def _mime(path: Column, kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair))
    return F.coalesce(F.nullif(kind, F.lit("")), F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^.]*)\z", 1))), F.lit("application/octet-stream"))


def _note(level: str, *text) -> Column:
    return F.array(F.struct(F.lit(level).alias("level"), F.concat(*(F.lit(t) if isinstance(t, str) else t.cast("string") for t in text)).alias("text")))


def parse_folders(files: DataFrame, by: str = "doc_id") -> DataFrame:
    """``doc_id, notices, questions, missing`` of ``files(doc_id, path, type, content)``.

    The Markdown file of least depth counts, then the first by name.  References count from the whole text.  A
    folder without such a file has one notice and no questions.  Files are chosen and references resolved by names alone; then the
    contents of the papers and of the pictures that are shown are joined, once each.
    """
    names = files.select(by, "path", "type")
    chosen = W.pick_markdown(names, [by]).select(by, "path")
    text = files.where(W.is_markdown(F.col("path"), F.col("type"))).join(chosen, [by, "path"]).select(by, F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    image = W.is_image(F.col("path"), F.col("type"))
    images = names.where(image).select(by, "path", F.col("path").alias("url"), F.col("path").alias("seq"))
    number = images.groupBy(by).agg(F.count("*").alias("images"))
    keys = images.select(by, F.explode(A.keys_of(F.col("path"))).alias("key")).distinct().groupBy(by).agg(F.count("*").alias("keys"))
    refs = text.select(by, F.posexplode(matches_of(F.col("text"), r"!\[[^\]]*\]\(([^)]+)\)", 1)).alias("pos", "raw")).select(by, "pos", M.image_target(F.col("raw")).alias("src"))
    first = refs.groupBy(by, "src").agg(F.min("pos").alias("pos"))
    resolved = A.resolve(first, images, [by]).withColumn("file", F.when(~A.is_direct(F.col("src")), F.col("url")))
    wanted = resolved.where("file is not null").select(by, F.col("file").alias("path")).distinct()
    shown = files.where(image).join(wanted, [by, "path"]).select(by, F.col("path").alias("file"), U.data_url(_mime(F.col("path"), F.col("type")), F.col("content")).alias("held"))
    resolved = resolved.join(shown, [by, "file"], "left").withColumn("url", F.when(F.col("file").isNull(), F.col("url")).otherwise(F.col("held")))
    # a paper's references, each once
    found = resolved.groupBy(by).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("url").isNotNull(), F.struct("src", "url")))).alias("urls"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("url").isNull(), F.struct("pos", "src")))), lambda x: x["src"]).alias("missing"),
    )
    none = F.array().cast("array<string>")
    # linked below the next joins, so that the formulas' Python stage gets a plain column
    linked = dealt(text, by).join(found, by, "left").select(by, F.when(F.col("urls").isNull(), F.col("text")).otherwise(_linked(F.col("text"), F.col("urls"))).alias("text"), F.coalesce("missing", none).alias("missing"))
    papers = linked.join(keys, by, "left").join(number, by, "left").select(by, "text", F.coalesce("keys", F.lit(0)).alias("keys"), "missing", F.coalesce("images", F.lit(0)).alias("images"))
    parsed = parse_papers(papers, by=by, keys="keys", missing="missing").join(papers.select(by, "missing", "images"), by)
    last = F.when(F.col("images") > 0, _note("ok", LOADED[0], F.col("images"), LOADED[1])).when(F.size("missing") > 0, _note("warn", LOST[0], F.size("missing"), LOST[1])).otherwise(_note("tip", NONE))
    whole = parsed.select(by, F.concat("notices", last).alias("notices"), "questions", "missing")
    lone = files.select(by).distinct().join(chosen, by, "left_anti")
    return whole.unionByName(lone.select(by, _note("warn", NO_PAPER).alias("notices")), allowMissingColumns=True)


def _linked(text: Column, urls: Column) -> Column:
    """The text with the pictures that were found in place of their paths."""

    def one(match: Column) -> Column:
        alt, raw = (F.regexp_extract(match, r"!\[([^\]]*)\]\(([^)]+)\)", k) for k in (1, 2))
        return let(F.try_element_at(urls, M.image_target(raw)), lambda url: F.when(url.isNull(), match).otherwise(F.concat(F.lit("!["), alt, F.lit("]("), url, F.lit(")"))))

    return rewrite_matches(text, IMAGE, one)


def as_json(parsed: DataFrame, by: str = "doc_id") -> DataFrame:
    """``doc_id, json``: questions, notices, their texts as warnings, and references without a picture."""
    warnings = F.transform("notices", lambda n: n["text"])
    body = F.struct(F.coalesce("questions", F.array()).alias("questions"), "notices", warnings.alias("warnings"), F.coalesce("missing", F.array()).alias("unresolvedImages"))
    return parsed.select(by, F.to_json(body).alias("json"))
