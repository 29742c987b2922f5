"""Documents to packed training sequences.

Each stage takes the documents that its predecessor kept, written and read again, and returns
those it keeps with the columns of ``documents``; the last returns the packed pieces.  A stage
decides on rows, told by id and a hash of the text, and drops the rejected ones by an anti-join on both, broadcast
only while their counted number is bounded, so texts move through a shuffle only beyond that.

Defined cases, for every stage: a null text counts as empty.  A row with a null id takes part under an id made of its
text's hash, which loses to any other, and is kept or dropped like any other; its id stays null in the result.  Of rows that share an id, each is judged
by its own text, but near copies of one id count as one document.  Rows repeated with id and text are judged alike; exact dedup leaves
one of them.  Ties fall to the larger id in exact dedup, to the smaller one in near dedup.  Empty tables give no rows, extra
columns are handed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import BROADCAST_IDS, made, materialize, release, text_hash
from quillspark.llm.decontaminate import decontaminate
from quillspark.llm.exact_dedup import exact_dedup
from quillspark.llm.near_dedup import NearDup, near_dedup
from quillspark.llm.packing import pack
from quillspark.llm.quality import quality
from quillspark.llm.queries import documents, table, tokenizer_path

#: Ids of rows without one are beyond this, or below its negative where the larger id wins.
NULL_IDS = 1 << 62


def _free(docs: DataFrame, *names: str) -> list[str]:
    """These names, lengthened until the documents have no such column."""
    used = {c.lower() for c in docs.columns}
    end = ""
    while any(f"{n}{end}".lower() in used for n in names):
        end += "_"
    return [n + end for n in names]


def _own_id(sign: int):
    return F.coalesce(F.col("doc_id").cast("long"), sign * (F.lit(NULL_IDS) + F.pmod(text_hash(), F.lit(NULL_IDS))))


def _told(docs: DataFrame, sign: int = 1) -> DataFrame:
    """The documents with an id in every row, for the operators."""
    return docs.withColumn("doc_id", _own_id(sign))


def _among(docs: DataFrame, rows: DataFrame, how: str, sign: int = 1) -> DataFrame:
    """Rows of ``docs`` that are (``left_semi``) or aren't (``left_anti``) among ``rows(doc_id, text_hash)``."""
    own_id, own_hash, r_id, r_hash = _free(docs, "__row_id", "__row_hash", "__of_id", "__of_hash")
    right = rows.select(F.col("doc_id").alias(r_id), F.col("text_hash").alias(r_hash))
    right = F.broadcast(right) if right.count() <= BROADCAST_IDS else right
    marked = docs.withColumn(own_id, _own_id(sign)).withColumn(own_hash, text_hash())
    return marked.join(right, (F.col(own_id) == F.col(r_id)) & (F.col(own_hash) == F.col(r_hash)), how).drop(own_id, own_hash)


def _without(docs: DataFrame, rejected: DataFrame, sign: int = 1) -> DataFrame:
    return _among(docs, materialize(rejected.select("doc_id", "text_hash").distinct(), "rejected", small=True), "left_anti", sign)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; an empty one is judged like any other."""
    return _without(docs, quality(_told(docs), table(spark, sf_dir, "labels")).where(~F.col("kept")))


def exact_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of equal texts: that of the largest id, one of them where it is repeated."""
    found = materialize(exact_dedup(_told(docs, -1)).select("doc_id", "text_hash", "group_size", "kept"), "exact")
    rest = _without(docs, found.where(~F.col("kept")), -1)
    again = materialize(found.where("kept and group_size > 1").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1"), "repeated", small=True)
    if again.isEmpty():
        return rest
    # only repeated rows are compared as rows
    own_id, own_hash = _free(rest, "__row_id", "__row_hash")
    one = _among(rest, again, "left_semi", -1).withColumn(own_id, _own_id(-1)).withColumn(own_hash, text_hash()).dropDuplicates([own_id, own_hash]).drop(own_id, own_hash)
    return _among(rest, again, "left_anti", -1).unionByName(one)


def near_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8 or more), that of the smallest id.

    Documents without words are no copies of each other and stay.
    """
    return _without(docs, near_dedup(_told(docs), NearDup(words=5, percent=80)).where(~F.col("kept")))


def decontamination_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; one that holds some goes as a whole."""
    return _without(docs, decontaminate(_told(docs), table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences of 4096 tokens; an empty text is one end token."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_filter),
    ("exact_dedup", exact_dedup_filter),
    ("near_dedup", near_dedup_filter),
    ("decontamination", decontamination_filter),
    ("best_fit_packing", packing),
]

#: SQL can't express the trained classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's tables are removed as soon as its result is written."""
    docs, since = documents(spark, sf_dir), made()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, since)
    return STAGES[-1][1](spark, docs, sf_dir)
