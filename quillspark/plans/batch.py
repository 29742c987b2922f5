"""Whole folders: Word files to Markdown files with their pictures, rewritten Word files, papers to JSON files.

Outputs mirror the folders below the source.  Every file is written by ``write_files``: whole or not at all, replaced by later runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vector_pictures as V
from ..sources import docx as D
from ..sources.files import below, qualified, write_files
from . import convert, folders


def _found(spark: SparkSession, source: str, recursive: bool) -> DataFrame:
    """``doc_id, path`` (below the source) and ``content`` of the Word files."""
    top = qualified(spark, source)
    return D.scan(spark, source, recursive).withColumn("path", below(F.col("path"), top))


def _beside(path: Column, name: Column) -> Column:
    """A file in the folder of ``path``."""
    return F.concat(F.regexp_extract(path, r"\A(.*/)?[^/]*\z", 1), name)


def convert_folder(spark: SparkSession, source: str, target: str, recursive: bool = False, folder: str = "assets", **options) -> DataFrame:
    """Write ``name.md`` for every Word file and the pictures it links in ``folder`` beside it; returns ``path, out_path, error`` of all files.

    Word files of one folder share their pictures' folder; of pictures with one name that of the last file by path is kept, as if files
    were converted one after the other.  Vector pictures that hold a bitmap become PNG.  A file that can't be read is told with its error and has no output.  ``options`` are those of
    ``to_markdown``.
    """
    docs = _found(spark, source, recursive)
    names = docs.select("doc_id", "path")
    pngs = V.pngs(D.parts(docs, under="word/media/"))
    made = convert.to_markdown(docs, folder=folder, pngs=pngs, **options)
    out = F.regexp_replace("path", r"(?i)\.docx\z", ".md")
    text = made.select("doc_id", F.encode("md", "UTF-8").alias("data")).where("data IS NOT NULL").join(names, "doc_id").select(out.alias("place"), "data", "path")
    pictures = convert.image_files(docs, made, folder=folder, pngs=pngs).withColumnRenamed("path", "name").join(names, "doc_id")
    files = text.unionByName(pictures.select(_beside(F.col("path"), F.col("name")).alias("place"), "data", "path"))
    write_files(files.groupBy(F.col("place").alias("path")).agg(F.max_by("data", F.col("path")).alias("data")), target)
    return made.select("doc_id", "error").join(names, "doc_id").select("path", F.when(F.col("error").isNull(), out).alias("out_path"), "error")


def rewrite_folder(spark: SparkSession, source: str, target: str, recursive: bool = False) -> DataFrame:
    """Write every Word file with its embedded objects as LaTeX; returns ``path, formulas`` of all files.

    The target must not be the source, whose files would be lost.
    """
    if qualified(spark, source) == qualified(spark, target):
        raise ValueError("the target is the source")
    docs = _found(spark, source, recursive)
    made = convert.without_objects(docs).join(docs.select("doc_id", "path"), "doc_id")
    write_files(made.select("path", F.col("content").alias("data")), target)
    return made.select("path", "formulas")


def write_papers(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Write ``name.json`` for every folder of the source; returns ``doc_id, json``."""
    made = folders.as_json(folders.parse_folders(folders.scan_folders(spark, source)))
    write_files(made.select(F.concat("doc_id", F.lit(".json")).alias("path"), F.encode("json", "UTF-8").alias("data")), target)
    return made
