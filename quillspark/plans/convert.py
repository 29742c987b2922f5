"""Word files to Markdown and questions: clean, mark formulas, write HTML, rewrite, substitute.

A file's parts are read where its bytes are; cleaning and HTML need only the document and its
relationships, which meet in one group-by on ``doc_id``.  The rest is JVM expressions.  A file
that can't be read gives a row with an ``error`` and doesn't stop the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import paper as P
from ..functions.latex import unicode_to_latex
from ..operators.assets import rewritten
from ..operators.clean import clean_document, objects_as_latex, preprocess_document
from ..operators.docx_html import Media, to_html
from ..operators.fragment import fragment_html
from ..operators.latex_repair import prepare
from ..operators.mtef import convert_object, ole_formula
from ..sources import docx as D
from ..sources.tables import dealt

FORMULA = "array<struct<formula_id:string,latex:string,display:boolean,source:string,picture:string,sha1:string,style:string,object:string>>"
IMAGE = "array<struct<image_id:string,name:string,part:string,sha1:string>>"
FORMULA_FIELDS = {"formula_id": pa.string(), "latex": pa.string(), "display": pa.bool_(), "source": pa.string(), "picture": pa.string(), "sha1": pa.string(), "style": pa.string(), "object": pa.string()}
IMAGE_FIELDS = {"image_id": pa.string(), "name": pa.string(), "part": pa.string(), "sha1": pa.string()}


def to_markdown(
    docs: DataFrame, level: str = "aggressive", keep_footnotes: bool = True, fallback: str = "image", by: str = "doc_id", folder: str = "image",
    pngs: DataFrame | None = None, objects: str = "picture", preprocess: bool = False,
) -> DataFrame:
    """``doc_id, raw_md, md, formulas, images, error`` of ``docs(doc_id, content)``.

    ``images`` tells which part goes to which file in ``folder``.  A formula that is an embedded object shows its preview
    picture (``objects`` "picture"), or its LaTeX where it can be decoded ("latex").  ``pngs(sha1)`` are vector pictures that
    have been rasterised; they are linked as PNG, the others as they are.  ``preprocess`` replaces tabs and drops blank paragraphs first.
    """
    kind = docs.schema[by].dataType.simpleString()
    types = (pa.string(), *(pa.list_(pa.struct(list(f.items()))) for f in (FORMULA_FIELDS, IMAGE_FIELDS)), pa.string())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content in batch.column(1):
                package = D.Package(content.as_py())
                media = Media(package, folder=folder)
                xml = package.read("word/document.xml")
                xml = preprocess_document(xml)[0] if preprocess else xml
                html, found = to_html(clean_document(xml, level), media)
                for f in found if objects == "latex" else ():
                    latex = convert_object(package.read(f["object"]))[1] if f.get("object") else ""
                    f["latex"] = f.get("latex") or (latex if latex and not latex.startswith("【") else None)
                rows.append((html, found, media.images, None if html is not None else "no readable word/document.xml"))
            cols = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[by, "html", "formulas", "images", "error"])

    raw = docs.select(by, "content").mapInArrow(read, f"{by} {kind}, html string, formulas {FORMULA}, images {IMAGE}, error string").withColumn("raw_md", M.html_to_markdown(F.col("html")))
    if objects == "latex":
        raw = raw.withColumn("formulas", F.transform("formulas", lambda f: f.withField("latex", F.when(f["source"] == "mathtype", unicode_to_latex(f["latex"])).otherwise(f["latex"]))))
    raw = _with_pngs(raw, pngs, by)
    wide = F.transform("formulas", lambda f: F.struct(F.concat(F.lit("⟦MT:"), f["formula_id"], F.lit("⟧")).alias("mark"), _rendered(f, fallback, folder, F.col("done")).alias("md")))
    done = F.aggregate(wide, F.col("raw_md"), lambda text, f: _once(text, f["mark"], f["md"]))
    keys = lambda i, name: F.array(*(F.struct(k.alias("k"), name.alias("v")) for k in (F.lower(name), F.lower(F.regexp_replace(name, r"\.[^.]*\z", "")), F.concat(F.lit("#"), i["image_id"]))))
    names = F.map_from_entries(F.flatten(F.transform("images", lambda i: keys(i, i["name"]))))
    linked = raw.withColumn("done_md", done).withColumn("done_md", F.when(F.size("images") == 0, F.col("done_md")).otherwise(rewritten(F.col("done_md"), names, folder)))
    # a picture that was rasterised is linked, and told, as PNG
    png = lambda i: F.when(i["name"].startswith("glyph") & F.array_contains("done", i["sha1"]), F.regexp_replace(i["name"], r"\.[^.]*\z", ".png")).otherwise(i["name"])
    shown = F.aggregate("images", F.col("done_md"), lambda text, i: F.replace(text, F.concat(F.lit(f"({folder}/"), i["name"], F.lit(")")), F.concat(F.lit(f"({folder}/"), png(i), F.lit(")"))))
    images = F.transform("images", lambda i: i.withField("name", png(i)))
    return linked.select(by, "raw_md", M.postprocess(shown, keep_footnotes).alias("md"), "formulas", images.alias("images"), "error")


def _with_pngs(raw: DataFrame, pngs: DataFrame | None, by: str) -> DataFrame:
    """``done``: the digests of each document's vector pictures that have been rasterised."""
    none = F.array().cast("array<string>")
    if pngs is None:
        return raw.withColumn("done", none)
    wanted = F.array_distinct(F.concat(F.transform("formulas", lambda f: f["sha1"]), F.transform("images", lambda i: i["sha1"])))
    # digests move, not texts; a picture that very many documents share is one row of pngs, and adaptive execution splits its key
    held = raw.select(by, F.explode(wanted).alias("sha1")).join(pngs.select("sha1").distinct(), "sha1").groupBy(by).agg(F.collect_set("sha1").alias("done"))
    return raw.join(held, by, "left").withColumn("done", F.coalesce("done", none))


def _rendered(f, fallback: str, folder: str, done):
    """A formula's Markdown: its LaTeX, else its picture, else what the fallback says."""
    body = F.trim(f["latex"])
    wait = F.concat(F.lit("`[公式 "), f["formula_id"], F.lit(" 待处理]`"))
    code = F.concat(F.lit("```\n[formula "), f["formula_id"], F.lit(" / "), f["source"], F.lit("]\n```"))
    dollars = F.when(f["display"], F.lit("$$")).otherwise(F.lit("$"))
    picture = F.concat(F.lit("!["), f["formula_id"], F.lit(f"]({folder}/formula"), f["formula_id"], F.when(F.array_contains(done, f["sha1"]), ".png)").otherwise(".wmf)"))
    return (
        F.when(F.coalesce(f["latex"], F.lit("")) != "", F.concat(dollars, body, dollars)).when(f["picture"].isNotNull(), picture)
        .otherwise(code if fallback == "code" else wait)
    )


def image_files(docs: DataFrame, markdown: DataFrame, by: str = "doc_id", folder: str = "image", pngs: DataFrame | None = None) -> DataFrame:
    """``doc_id, path, data`` of the pictures that ``to_markdown`` links, as they are in the files.

    Vector pictures that were rasterised have their PNG where that was done, or in ``pngs(sha1, png)``, from which they are then told too.
    """
    if pngs is not None:
        return _with_png_files(docs, markdown, by, folder, pngs)
    shown = markdown.select(by, F.explode("images").alias("i")).select(by, F.col("i.part").alias("part"), F.concat(F.lit(f"{folder}/"), "i.name").alias("path"))
    previews = markdown.select(by, F.explode("formulas").alias("f")).where("f.latex is null and f.picture is not null")
    previews = previews.select(by, F.col("f.picture").alias("part"), F.concat(F.lit(f"{folder}/formula"), "f.formula_id", F.lit(".wmf")).alias("path"))
    wanted = shown.where(~F.col("path").rlike(r"/glyph[0-9]+\.png\z")).unionByName(previews)
    return wanted.join(D.parts(docs, by, under="word/"), [by, "part"]).select(by, "path", "data")


def _with_png_files(docs: DataFrame, markdown: DataFrame, by: str, folder: str, pngs: DataFrame) -> DataFrame:
    plain = image_files(docs, markdown, by, folder)
    shown = markdown.select(by, F.explode("images").alias("i")).select(by, F.concat(F.lit(f"{folder}/"), "i.name").alias("path"), F.col("i.sha1").alias("sha1")).where(F.col("path").rlike(r"/glyph[0-9]+\.png\z"))
    previews = markdown.select(by, F.explode("formulas").alias("f")).where("f.latex is null and f.picture is not null")
    previews = previews.select(by, F.concat(F.lit(f"{folder}/formula"), "f.formula_id", F.lit(".png")).alias("path"), F.col("f.sha1").alias("sha1"))
    made = shown.unionByName(previews).join(pngs.select("sha1", F.col("png").alias("data")).dropDuplicates(["sha1"]), "sha1").select(by, "path", "data")
    # a preview is told once, as PNG where there is one
    gone = made.select(by, F.regexp_replace("path", r"\.png\z", ".wmf").alias("path"))
    return plain.join(gone, [by, "path"], "left_anti").unionByName(made)


def without_objects(docs: DataFrame, by: str = "doc_id") -> DataFrame:
    """``doc_id, content, formulas``: files whose embedded objects are replaced by ``$LaTeX$``, without their parts.

    Objects are decoded once for equal bytes; each file is then rewritten from its own bytes and its formulas' texts.
    The enclosing object element is replaced, and all relationships in it and the parts of embedded ones among
    them go.  A file without a body stays as it is.
    """
    kind = docs.schema[by].dataType.simpleString()
    found = embedded_formulas(docs, by).groupBy(by).agg(F.collect_list(F.struct("source", "mathml", "latex")).alias("known"))
    item = pa.list_(pa.struct([("source", pa.string()), ("mathml", pa.string()), ("latex", pa.string())]))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [objects_as_latex(c.as_py(), k.as_py() or []) for c, k in zip(batch.column(1), batch.column(2), strict=True)]
            cols = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.binary(), item), strict=True))], names=[by, "content", "formulas"])

    return dealt(docs.select(by, "content"), by).join(found, by, "left").select(by, "content", "known").mapInArrow(rewrite, f"{by} {kind}, content binary, formulas array<struct<source:string,mathml:string,latex:string>>")


def _once(text, mark, new):
    at = F.instr(text, mark)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(mark), F.length(text)))).otherwise(text)


def questions(markdown: DataFrame, column: str = "md", by: str = "doc_id") -> DataFrame:
    """``doc_id, id, index, stem, answer, analysis, detail``; ids are made from content, not from time."""
    rows = markdown.select(by, F.explode(P.questions(F.col(column))).alias("q"))
    uid = F.concat(F.lit("imp-q-"), F.col("q.index").cast("string"), F.lit("-"), F.substring(F.sha1(F.concat(F.col(by).cast("string"), F.lit("|"), F.col("q.stem"))), 1, 8))
    return rows.select(by, uid.alias("id"), "q.index", "q.stem", "q.answer", "q.analysis", "q.detail")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = pa.array([None if t is None else prepare(t) for t in batch.column("paper").to_pylist()], pa.string())
        yield batch.set_column(batch.schema.get_field_index("paper"), "paper", text)


def parse_papers(papers: DataFrame, column: str = "text", by: str = "doc_id", keys: str | None = None, missing: str | None = None) -> DataFrame:
    """``doc_id, notices, questions`` of raw Markdown papers, the questions' parts as HTML.

    The text's formulas are repaired before it is split; ``stem_text`` is the stem's first 200
    characters without tags.  The result has the shape of the JSON that ``to_json`` makes of it.
    ``keys`` and ``missing`` name the columns with the number of keys of pictures and the references without one, for the notices.
    """
    more = {c: name for c, name in (("keys", keys), ("missing", missing)) if name}
    rows = papers.select(by, P.normalize(F.col(column)).alias("paper"), *(F.col(name).alias(c) for c, name in more.items()))
    # a stage of its own, so that the optimizer copies the scanners into no other expression
    found = rows.mapInArrow(_repaired, rows.schema).withColumn("paper", P.normalize(F.col("paper"))).withColumn("qs", P.questions(F.col("paper")))
    notes = found.select(by, P.notices(F.col("paper"), F.col("qs"), **{c: F.col(c) for c in more}).alias("notices"))
    rows = found.select(by, F.explode("qs").alias("q")).select(
        by, "q.index", "q.place", *(fragment_html(F.col(f"q.{k}")).alias(f"{k}_html") for k in ("stem", "answer", "analysis", "detail"))
    )
    item = F.struct("index", "place", "stem_html", "answer_html", "analysis_html", "detail_html", F.substring(M.plain_text(F.col("stem_html")), 1, 200).alias("stem_text"))
    return notes.join(rows.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("questions")), by, "left")


def embedded_formulas(docs: DataFrame, by: str = "doc_id") -> DataFrame:
    """``doc_id, source, mathml, latex`` of embedded objects; equal objects are decoded once.

    Digests and results are joined back, not bytes; an object that very many files share is split by adaptive execution.
    """
    objects = D.members_under(D.parts(docs, by, under="word/embeddings/"), "word/embeddings/").select(by, F.element_at(F.split("part", "/", -1), -1).alias("source"), "data", F.sha1("data").alias("sha1"))
    decoded = objects.dropDuplicates(["sha1"]).select("sha1", ole_formula("data").alias("f"))
    marked = F.col("f.latex").startswith("【")
    latex = F.when(marked, F.col("f.latex")).otherwise(unicode_to_latex(F.col("f.latex")))
    return objects.drop("data").join(decoded, "sha1").select(by, "source", F.col("f.mathml").alias("mathml"), latex.alias("latex"))


def conversion_counts(markdown: DataFrame, by: str = "doc_id") -> DataFrame:
    """``doc_id, formulas, math_converted, image_count`` of converted files; those that failed have zeros."""
    many = lambda x: F.greatest(F.size(F.coalesce(x, F.array())), F.lit(0))
    done = F.filter("formulas", lambda f: F.coalesce(f["latex"], F.lit("")) != "")
    return markdown.select(by, many(F.col("formulas")).alias("formulas"), many(done).alias("math_converted"), many(F.col("images")).alias("image_count"))


def batch_counts(markdown: DataFrame, by: str = "doc_id") -> DataFrame:
    """One row: ``files, failed, formulas, math_converted, images`` of a batch, by partial sums."""
    counted = conversion_counts(markdown.withColumn(by, F.struct(by, "error")), by)
    return counted.agg(
        F.count("*").alias("files"), F.count(f"{by}.error").alias("failed"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in (("formulas", "formulas"), ("math_converted", "math_converted"), ("image_count", "images")))
    )


def write_markdown(markdown: DataFrame, path: str, by: str = "doc_id") -> None:
    """The batch sink: one Parquet table of documents, overwritten as a whole."""
    markdown.select(by, "md").write.mode("overwrite").parquet(path)


__all__ = ["batch_counts", "conversion_counts", "embedded_formulas", "image_files", "parse_papers", "questions", "to_markdown", "without_objects", "write_markdown"]
