"""Formula numbering, substitution and runs: windows and joins keyed by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regex import strip


def number(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Zero-padded counters per document; three digits at least, more where needed."""
    return rows.withColumn(name, F.format_string("%03d", F.row_number().over(Window.partitionBy(*by).orderBy(*order))))


def rendered(fallback: str = "image"):
    """A formula's Markdown: LaTeX, else its picture, else what the fallback says."""
    body = strip(F.col("latex"))
    code = F.concat(F.lit("```\n[formula "), "formula_id", F.lit(" / "), "source", F.lit("]\n```"))
    wait = F.concat(F.lit("`[公式 "), "formula_id", F.lit(" 待处理]`"))
    return (
        F.when(F.coalesce("latex", F.lit("")) != "", F.when(F.col("display"), F.concat(F.lit("$$"), body, F.lit("$$"))).otherwise(F.concat(F.lit("$"), body, F.lit("$"))))
        .when(F.col("image_path").isNotNull(), F.concat(F.lit("!["), "formula_id", F.lit("]("), "image_path", F.lit(")")))
        .otherwise(code if fallback == "code" else wait)
    )


def substitute(docs: DataFrame, formulas: DataFrame, by: list[str], text: str, fallback: str = "image") -> DataFrame:
    """Each formula replaces the first place of the first of its marks that the text holds.

    Marks by rank: ``⟦MT:id⟧``, ``[[MT:id]]``, the link and the bare form of ``[FORMULA_id]``.  A
    document's formulas are gathered into one small array; texts are joined once and not exploded.
    """
    ranked = formulas.select(*by, F.struct("formula_id", rendered(fallback).alias("md")).alias("f")).groupBy(*by).agg(F.array_sort(F.collect_list("f")).alias("fs"))

    def put(text, f):
        fid = f["formula_id"]
        marks = [F.concat(F.lit("⟦MT:"), fid, F.lit("⟧")), F.concat(F.lit("[[MT:"), fid, F.lit("]]"))]
        link = F.regexp_extract(text, r"(\[FORMULA_([0-9]+)\]\([^)]*FORMULA_\2[^)]*\))", 1)
        marks += [F.when((link != "") & link.startswith(F.concat(F.lit("[FORMULA_"), fid, F.lit("]"))), link), F.concat(F.lit("[FORMULA_"), fid, F.lit("]"))]
        mark = F.coalesce(*(F.when(text.contains(m), m) for m in marks))
        at = F.instr(text, mark)
        return F.when(mark.isNull(), text).otherwise(F.concat(F.substring(text, F.lit(1), at - 1), f["md"], F.substring(text, at + F.length(mark), F.length(text))))

    joined = docs.join(ranked, by, "left")
    return joined.withColumn(text, F.when(F.col("fs").isNull(), F.col(text)).otherwise(F.aggregate("fs", F.col(text), put))).drop("fs")


def longest_run(rows: DataFrame, by: list[str], order: list[str], flag: str, name: str) -> DataFrame:
    """The longest run of flagged rows per document: islands between unflagged rows."""
    w = Window.partitionBy(*by).orderBy(*order)
    islands = rows.withColumn("__island", F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w))
    return islands.groupBy(*by, "__island").agg(F.count_if(F.col(flag)).alias("__n")).groupBy(*by).agg(F.max("__n").alias(name))
