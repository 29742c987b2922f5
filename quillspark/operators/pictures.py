"""Pictures and embedded objects of Word files: names, sizes, and objects replaced by LaTeX.

References are resolved by equi-joins of elements, relationships and parts within a document;
blobs are compared by SHA-1, and of several sizes of one blob the last written wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import units as U
from ..sources import docx as D
from .inspector import is_element, suffix

R = D.NS["r"]


def image_names(parts: DataFrame, by: str = "doc_id") -> DataFrame:
    """``(doc_id, image_id, original, name, vector)`` of the media in order of their names.

    JPEGs get ``.jpg``, files without an extension ``.bin``; vector pictures keep their kind, as
    nothing here rasterises them.
    """
    media = D.members_under(parts, "word/media/")
    n = F.row_number().over(Window.partitionBy(by).orderBy("part"))
    ext = suffix(F.col("part"))
    out = F.when(ext == "(none)", ".bin").when(ext == ".jpeg", ".jpg").otherwise(ext)
    rows = media.select(by, F.format_string("%03d", n).alias("image_id"), F.element_at(F.split("part", "/", -1), -1).alias("original"), out.alias("ext"), F.when(ext.isin(".wmf", ".emf"), U.vector_kind(F.col("data"))).alias("vector"))
    return rows.select(by, "image_id", "original", F.concat(F.lit("image"), "image_id", "ext").alias("name"), "vector")


def layout_sizes(nodes: DataFrame, rels: DataFrame, parts: DataFrame, by: str = "doc_id") -> DataFrame:
    """``(doc_id, sha1, width_px, height_px)`` from shapes, then inline, then anchored pictures."""
    inside = (F.col("node_id") >= F.col("at")) & (F.col("node_id") <= F.col("upto"))
    shapes = nodes.where(is_element("v:shape")).select(by, "part", F.col("node_id").alias("at"), F.col("last_desc").alias("upto"), F.col("attrs")["style"].alias("style"))
    width, height = U.shape_points(F.col("style"))
    shapes = shapes.select(by, "part", "at", "upto", F.lit(0).alias("rank"), width.alias("w"), height.alias("h"))
    wraps = nodes.where(is_element("wp:inline") | is_element("wp:anchor")).select(by, "part", F.col("node_id").alias("at"), F.col("last_desc").alias("upto"), F.when(F.col("local") == "inline", 1).otherwise(2).alias("rank"))
    extents = nodes.where(is_element("wp:extent")).select(by, "part", F.col("parent_id").alias("at"), *((F.col("attrs")[k].try_cast("long") / 12700.0).alias(n) for k, n in (("cx", "w"), ("cy", "h"))))
    boxes = shapes.unionByName(wraps.join(extents, [by, "part", "at"]).select(by, "part", "at", "upto", "rank", "w", "h"))
    rid = F.coalesce(F.col("attrs")[f"{{{R}}}id"], F.col("attrs")[f"{{{R}}}embed"])
    marks = nodes.where(is_element("v:imagedata") | is_element("a:blip")).select(by, "part", "node_id", F.col("local").alias("kind"), rid.alias("rid"))
    # an interval test within one document's part; shapes hold image data, wraps hold blips
    fit = marks.join(boxes.where("w is not null and h is not null"), [by, "part"]).where(inside & ((F.col("rank") == 0) == (F.col("kind") == "imagedata")))
    blobs = parts.select(by, F.col("part").alias("target"), F.sha1("data").alias("sha1"))
    sized = fit.join(rels, [by, "rid"]).join(blobs, [by, "target"])
    last = F.struct("rank", "node_id")
    px = lambda c: F.max_by(U.points_to_pixels(F.col(c)), last)
    return sized.groupBy(by, "sha1").agg(px("w").alias("width_px"), px("h").alias("height_px"))


def ole_parts(nodes: DataFrame, rels: DataFrame, parts: DataFrame, by: str = "doc_id") -> DataFrame:
    """``(doc_id, node_id, rid, part, data)`` of embedded objects that can be found.

    ``rels`` are the raw relationships; a part is ``word/`` and the target.
    """
    objects = nodes.where(is_element("o:OLEObject")).select(by, "node_id", F.col("attrs")[f"{{{R}}}id"].alias("rid"))
    held = rels.where(F.col("target").contains("embeddings/")).select(by, "rid", F.concat(F.lit("word/"), "target").alias("part"))
    return objects.join(held, [by, "rid"]).join(parts.select(by, "part", "data"), [by, "part"])


def without_objects(parts: DataFrame, rels: DataFrame, found: DataFrame, by: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Parts and relationships less those of the objects that were replaced."""
    return parts.join(found.select(by, "part"), [by, "part"], "left_anti"), rels.join(found.select(by, "rid"), [by, "rid"], "left_anti")


def formula_pictures(formulas: DataFrame, rels: DataFrame, parts: DataFrame, pngs: DataFrame | None = None, by: str = "doc_id", folder: str = "image") -> DataFrame:
    """``(doc_id, formula_id, sha1, image_path)`` of ``formulas(doc_id, formula_id, rid)`` whose picture is there.

    The picture's relationship and part are found by equi-joins within the document; ``pngs(sha1)`` are pictures
    that were rasterised, by digest, as one picture stands in many documents; the others keep their vector file.
    """
    blobs = parts.select(by, F.col("part").alias("target"), F.sha1("data").alias("sha1"))
    found = formulas.join(rels, [by, "rid"]).join(blobs, [by, "target"])
    done = F.lit(False) if pngs is None else F.col("done").isNotNull()
    found = found if pngs is None else found.join(pngs.select("sha1", F.lit(True).alias("done")).distinct(), "sha1", "left")
    name = F.concat(F.lit(f"{folder}/formula"), "formula_id", F.when(done, ".png").otherwise(".wmf"))
    return found.select(by, "formula_id", "sha1", name.alias("image_path"))
