"""Operator 10: exact duplicates by a tree-merge of digest runs, DataFrame functions only.

Each input partition is one run of digests.  Its copies are combined where they are read, so a
text that fills a third of the table leaves its partition as one row.  Runs then meet in
binomial rounds: in each, ``radix`` runs whose numbers agree but for their last digit exchange
their rows by digest, are sorted and merged in one sweep, every class keeping its smallest and largest identifier
and its size, until one run is left.  With ``radix`` 2 runs meet in pairs; as every round moves each class once,
the default is the root of the number of runs, so that two rounds of multiway merging suffice for any number.
A class is verified at every level, for the merge key holds
SHA-256, the length in bytes and an independent 64-bit hash: rows that agree in one but not in
the others never meet.  A round moves one row per class and run and combines before it
exchanges, so no task holds a class's members.  That a text stands alone is known only when all runs have met.

Defined cases: a null text counts as empty, and the empty texts form one class.  Rows repeated
with one doc_id are members of one class, and all those with the kept id are kept.  A null doc_id
loses to any other; a class of null ids alone keeps them.  An empty table gives no rows.
Columns other than the id and the text are not read, so clashing names don't matter.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_of

#: About 100 bytes each: some 20 MB as a relation.
BROADCAST_CLASSES = 100_000
KEY = ["digest", "n_bytes", "check64"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id`` and the three parts of its text's key."""
    text = text_of(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.xxhash64(text).alias("check64"),
    )


def merge_runs(keyed: DataFrame, runs: int, radix: int) -> DataFrame:
    """All classes ``(digest, n_bytes, check64, min_id, max_id, members)`` by rounds of merging.

    ``keyed`` has at most ``runs`` partitions.
    """
    level, number = keyed.select(*KEY, F.col("doc_id").alias("min_id"), F.col("doc_id").alias("max_id"), F.lit(1).cast("long").alias("members")), F.spark_partition_id()
    first = True
    while first or runs > 1:
        runs = -(-runs // radix)
        level = level.withColumn("run", F.floor(number / radix).cast("int"))
        if first:
            # a run's copies are combined in its own task, then exchanged and merged
            level = level.groupBy(*KEY, "run").agg(F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"), F.sum("members").alias("members"))
        else:
            # each task sorts what it got and merges equal keys in one sweep of at most `radix` rows
            # a key, of which the row with the smallest identifier stays
            key = Window.partitionBy(*KEY, "run")
            up = level.select(
                *KEY, "run",
                F.row_number().over(key.orderBy("min_id")).alias("place"),
                F.min("min_id").over(key).alias("min_id"),
                F.max("max_id").over(key).alias("max_id"),
                F.sum("members").over(key).alias("members"),
            )
            level = up.where("place = 1").drop("place")
        first, number = False, F.col("run")
    return level.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", radix: int | None = None, broadcast_classes: int = BROADCAST_CLASSES) -> DataFrame:
    """Per input row: ``doc_id, keep_id, group_size, kept, text_sha256, first_id, last_id, text_hash``.

    The text is read once; what follows moves its 32-byte digest.  Only classes of two or more
    are joined back, as every other row is its own class: broadcast while their counted number is bounded,
    beyond it by a shuffle in which adaptive execution splits a class of many members.
    """
    keyed = materialize(digests(docs, id_col, text_col), "digests")
    runs = (keyed.select(F.spark_partition_id().alias("run")).agg(F.max("run").alias("last")).first()["last"] or 0) + 1
    groups = materialize(merge_runs(keyed, runs, radix or max(2, ceil(sqrt(runs)))).where("members > 1"), "classes", small=True)
    groups = F.broadcast(groups) if groups.count() <= broadcast_classes else groups.hint("merge")
    rows = keyed.join(groups, KEY, "left")
    first, last = F.coalesce("min_id", "doc_id"), F.coalesce("max_id", "doc_id")
    keep_id = last if keep == "largest" else first
    return rows.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("members", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        first.alias("first_id"),
        last.alias("last_id"),
        F.col("check64").alias("text_hash"),
    )
