"""Operator 3: lines that recur across documents, dropped everywhere but in one document.

A line's key is the line with ASCII white space stripped at both ends and A-Z lower-cased.
Each document sends the 128-bit hash of each of its distinct eligible keys once; Spark combines
them to one row per hash and doc_id, then to the number of documents and the largest id per hash, each time
before and after the shuffle, so a line of a third of all documents is spread by their ids first.
Only hashes over the threshold go back to the documents: as a broadcast table while their
counted number is within ``broadcast_lines``, else by joins on hash and on doc_id, in which
adaptive execution splits a line that a third of all documents hold.

Defined cases: a null or empty text is one empty line.  Rows repeated with one doc_id count as one document,
and those with the largest doc_id all keep the line; null ids count together as one document that
is never the largest, and lines of null ids alone stay.
Characters beyond ASCII are never folded or stripped.  An empty table gives no rows.  Columns
other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_i64, materialize, text_hash, tune

#: 24 bytes each: at most 24 MB are broadcast.
BROADCAST_LINES = 1_000_000


def _lines(text: str | None, min_chars: int) -> tuple[list[str], list[bytes | None]]:
    """The lines and, of those eligible, the 16-byte hashes of their keys."""
    from xxhash import xxh3_128_digest

    lines = (text or "").split("\n")
    hashes: list[bytes | None] = []
    for line in lines:
        key = line.encode("utf-8", "surrogatepass").strip().lower()
        # bytes bound the code points from above, so most short lines need no decoding
        long = len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars)
        hashes.append(xxh3_128_digest(key) if long else None)
    return lines, hashes


def _halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pair = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
    return pair[:, 0], pair[:, 1]


def line_hashes(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, text_hash, h1, h2)`` for each distinct eligible line of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0), []
            index = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = {h for h in _lines(text, min_chars)[1] if h is not None}
                out += own
                index += [i] * len(own)
            h1, h2 = _halves(out)
            which = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(which), batch.column(2).take(which), as_i64(h1), as_i64(h2)], names=["doc_id", "text_hash", "h1", "h2"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_hash(text_col).alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, h1 long, h2 long")


def _find(table: tuple[np.ndarray, np.ndarray, np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Positions in the table sorted by (h1, h2), or -1."""
    t1, t2, _ = table
    at = np.searchsorted(t1, h1)
    found = np.full(len(h1), -1)
    left = np.arange(len(h1))
    while len(left):  # equal first halves stand side by side; there is hardly ever a second
        left = left[at[left] < len(t1)]
        left = left[t1[at[left]] == h1[left]]
        hit = t2[at[left]] == h2[left]
        found[left[hit]] = at[left[hit]]
        left = left[~hit]
        at[left] += 1
    return found


def _emit(ids: pa.Array, rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    kept, n, dropped = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())],
        names=["doc_id", "kept_text", "n_lines", "n_dropped"],
    )


SCHEMA = "doc_id long, kept_text string, n_lines long, n_dropped long"


def dedup_lines(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", broadcast_lines: int = BROADCAST_LINES
) -> DataFrame:
    """Per input row: ``doc_id, kept_text, n_lines, n_dropped``."""
    spark = docs.sparkSession
    tune(spark)
    hashes = line_hashes(docs, min_chars, id_col, text_col)
    held = hashes.select("doc_id", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last_id"))
    hot = materialize(held.where((F.col("n") >= min_docs) & F.col("last_id").isNotNull()).drop("n"), "lines")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if hot.count() <= broadcast_lines:
        found = hot.toArrow()
        h1, h2 = found["h1"].to_numpy(), found["h2"].to_numpy()
        order = np.lexsort((h2, h1))
        last = found["last_id"].to_numpy()
        table = spark.sparkContext.broadcast((h1[order], h2[order], last[order]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                split = [_lines(t, min_chars) for t in batch.column(1).to_pylist()]
                flat = [h for _, hs in split for h in hs if h is not None]
                at = _find(table.value, *_halves(flat))
                out, k = [], 0
                for (lines, hs), own in zip(split, ids.to_pylist(), strict=True):
                    kept = []
                    for line, h in zip(lines, hs, strict=True):
                        if h is None:
                            kept.append(line)
                            continue
                        p = at[k]
                        k += 1
                        if p < 0 or table.value[2][p] == own:
                            kept.append(line)
                    out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
                yield _emit(ids, out)

        return rows.mapInArrow(run, SCHEMA)

    drop = (
        hashes.join(hot, ["h1", "h2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("last_id")))
        # by text too: no array holds more than one text's lines, however many rows have no id
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.struct("h1", "h2")).alias("drop"))
        .select(F.col("doc_id").alias("drop_id"), F.col("text_hash").alias("drop_hash"), "drop")
    )
    joined = rows.join(drop, rows["doc_id"].eqNullSafe(drop["drop_id"]) & (text_hash() == drop["drop_hash"]), "left").select("doc_id", "text", "drop")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines, hs = _lines(text, min_chars)
                gone = {(x["h1"], x["h2"]) for x in drop or ()}
                if gone:
                    flat = [h for h in hs if h is not None]
                    pairs = iter(zip(*(x.tolist() for x in _halves(flat)), strict=True))
                    kept = [line for line, h in zip(lines, hs, strict=True) if h is None or next(pairs) not in gone]
                else:
                    kept = lines
                out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
            yield _emit(batch.column(0), out)

    return joined.mapInArrow(cut, SCHEMA)
