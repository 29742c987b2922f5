"""Queries that write files of table columns, run whole folders over them, and read what came out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import docx as D
from ..sources.files import scan_files, scratch, write_files
from ..sources.tables import table
from . import batch, folders
from .convert_queries import _pictured

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _name(k: Column) -> Column:
    """Folders called like their parents, with special characters, deep or with escapes."""
    return F.when(k % 5 == 0, F.concat(F.lit("in/in/"), k)).when(k % 5 == 1, F.concat(F.lit("exam ("), k, F.lit(")"))).when(k % 5 == 2, F.concat(F.lit("图 é/"), k, F.lit(" b"))).when(k % 5 == 3, F.concat(F.lit("a%20b/[x]{"), k, F.lit("}"))).otherwise(k.cast("string"))


NAME = "CASE s_suppkey % 5 WHEN 0 THEN 'in/in/' || s_suppkey WHEN 1 THEN 'exam (' || s_suppkey || ')' WHEN 2 THEN '图 é/' || s_suppkey || ' b' WHEN 3 THEN 'a%20b/[x]{' || s_suppkey || '}' ELSE s_suppkey::VARCHAR END"


@query(f"SELECT {NAME} || '/' || p || '.txt' AS path, s_name || p AS text, 1::BIGINT AS files FROM supplier, (SELECT unnest(['x', 'y 1']) AS p) WHERE p = 'x' OR s_suppkey % 2 = 0")
def files_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of any name written twice and read back; rows without data write none."""
    root = scratch(spark) + "/in/in (1)"
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k, "s_name", F.explode(F.array(F.lit("x"), F.lit("y 1"))).alias("p"))
    data = F.when((F.col("p") == "x") | (k % 2 == 0), F.encode(F.concat("s_name", "p"), "UTF-8"))
    files = rows.select(F.concat(_name(k), F.lit("/"), "p", F.lit(".txt")).alias("path"), data.alias("data"))
    write_files(files.withColumn("data", F.encode(F.lit("old"), "UTF-8")).where("data IS NOT NULL").join(files.where("data IS NOT NULL").select("path"), "path"), root)
    write_files(files, root)
    found = scan_files(spark, root, "*.txt")
    return found.groupBy("path").agg(F.max(F.col("content").cast("string")).alias("text"), F.count("*").alias("files"))


@query(
    """SELECT 'exam (' || s_suppkey || ')' AS doc_id, '1. a' || s_suppkey AS stem, CASE s_suppkey % 4 WHEN 0 THEN 'data:image/png;base64,' || to_base64(encode('p' || s_suppkey)) WHEN 1 THEN 'data:image/gif;base64,' || to_base64(encode('g' || s_suppkey))
    WHEN 2 THEN 'http://h/a%20' || s_suppkey || '%25' ELSE 'img/none' || s_suppkey || '.png' END AS src, CASE WHEN s_suppkey % 4 = 3 THEN 1 ELSE 0 END AS missing FROM supplier"""
)
def paper_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers in folders whose names have special characters: pictures by encoded, dotted, direct and lost references."""
    root = scratch(spark) + "/in/in"
    k = F.col("s_suppkey")
    n = k.cast("string")
    ref = F.when(k % 4 == 0, F.concat(F.lit("img/%E5%9B%BE%20"), n, F.lit(".png"))).when(k % 4 == 1, F.concat(F.lit("img/./sub/./g"), n, F.lit(".GIF"))).when(k % 4 == 2, F.concat(F.lit("http://h/a "), n, F.lit("%25"))).otherwise(F.concat(F.lit("img/none"), n, F.lit(".png")))
    folder = F.concat(F.lit("exam ("), n, F.lit(")/"))
    text = lambda *xs: F.encode(F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs)), "UTF-8")
    item = lambda path, data: F.struct(F.concat(folder, path).alias("path"), data.alias("data"))
    files = F.array(
        item(F.lit("a.md"), text("1. a", n, " ![x](", ref, ")\n【答案】b")), item(F.lit("deep/a.md"), text("9. no")), item(F.lit("notes.txt"), text("x")),
        item(F.concat(F.lit("img/图 "), n, F.lit(".png")), F.when(k % 4 == 0, text("p", n))), item(F.concat(F.lit("img/sub/g"), n, F.lit(".gif")), F.when(k % 4 == 1, text("g", n))),
    )
    write_files(table(spark, sf_dir, "supplier").select(F.explode(files).alias("f")).select("f.*"), root)
    made = folders.parse_folders(folders.scan_folders(spark, root))
    stem = F.col("q.stem_html")
    rows = made.select("doc_id", F.size("missing").alias("missing"), F.explode("questions").alias("q"))
    return rows.select("doc_id", F.concat(F.lit("1. "), F.regexp_extract(stem, r"\A(\S+)", 1)).alias("stem"), F.regexp_extract(stem, 'src="([^"]*)"', 1).alias("src"), "missing")


@query(
    """SELECT path || '.md' AS path, 'q' || s_suppkey AS first_line, CASE WHEN s_suppkey % 2 = 0 THEN 'j' END AS picture FROM (SELECT *, CASE s_suppkey % 3 WHEN 0 THEN 'd ' || s_suppkey || '/x (1)' WHEN 1 THEN s_suppkey || '/图' ELSE 'r' || s_suppkey || '/y' END AS path FROM supplier)
    UNION ALL SELECT 'broken.docx' AS path, 'no readable word/document.xml' AS first_line, NULL AS picture"""
)
def batch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word files of a folder tree converted to files; each Markdown file's first line and the picture beside it."""
    base = scratch(spark)
    source, target = base + "/in (1)/in", base + "/out"
    k = F.col("s_suppkey")
    path = F.when(k % 3 == 0, F.concat(F.lit("d "), k, F.lit("/x (1)"))).when(k % 3 == 1, F.concat(k.cast("string"), F.lit("/图"))).otherwise(F.concat(F.lit("r"), k, F.lit("/y")))
    files = _pictured(spark, sf_dir).select(F.concat(path, F.when(k % 2 == 0, ".docx").otherwise(".DOCX")).alias("path"), F.col("content").alias("data"))
    more = spark.createDataFrame([("broken.docx", b"no zip"), ("1/~$lock.docx", b"x"), ("other.txt", b"y")], "path string, data binary")
    write_files(files.unionByName(more), source)
    told = batch.convert_folder(spark, source, target, recursive=True, folder="image")
    out = scan_files(spark, target, "*.[mj][dp]*")
    text = out.where(F.endswith("path", F.lit(".md"))).select("path", F.substring_index(F.col("content").cast("string"), "\n", 1).alias("first_line"), F.regexp_extract("path", r"\A(.*/)?[^/]*\z", 1).alias("folder"))
    pictures = out.where(F.endswith("path", F.lit("image/image001.jpg"))).select(F.regexp_extract("path", r"\A(.*/)?image/[^/]*\z", 1).alias("folder"), F.col("content").cast("string").alias("picture"))
    done = text.join(pictures, "folder", "left").select("path", "first_line", "picture")
    return done.unionByName(told.where("error IS NOT NULL").select("path", F.col("error").alias("first_line"), F.lit(None).cast("string").alias("picture")))


@query("SELECT s_suppkey::VARCHAR || '.docx' AS path, CASE WHEN s_suppkey % 3 = 1 THEN 5 ELSE 6 END::BIGINT AS parts FROM supplier")
def rewritten_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word files written again without their objects, and the parts that are left."""
    base = scratch(spark)
    write_files(_pictured(spark, sf_dir).select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".docx")).alias("path"), F.col("content").alias("data")), base + "/in")
    batch.rewrite_folder(spark, base + "/in", base + "/out")
    return D.parts(scan_files(spark, base + "/out", "*.docx").select("path", "content"), "path").groupBy("path").agg(F.count("*").alias("parts"))
