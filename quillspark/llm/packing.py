"""Operator 4: best-fit decreasing packing of tokenised documents into fixed-length sequences.

Tokens.  A document's ids come from the given tokenizer file, followed by one end id.  White space
never joins two tokens of this tokenizer, so each distinct white-space-separated chunk is encoded
once per worker and its ids are reused (the cache is bounded).  Only documents longer than a
sequence are cut.

Packing.  Pieces of one length are interchangeable, so best-fit decreasing over all pieces equals
best-fit decreasing over the histogram of lengths, which has at most ``capacity`` entries whatever
the input.  The driver takes lengths in falling order and, in a segment tree over remaining
capacities, finds the tightest open bin for each in logarithmic time; bins with equal room are held
as ranges and a bin takes as many pieces of the length as it holds, which is what piece-by-piece
best fit does with equal pieces.  The result is a plan of at most a few ten thousand ranges
(n-th piece of this length -> sequence, offset), bounded by ``capacity`` and not by the data.
Executors give each piece its rank among those of its length (local rank where it was written plus
a running sum of counts per shard) and look its place up in the plan.

Defined cases: a null text is an empty one, one end id.  Repeated rows are packed as often as they
occur.  Ties (equal lengths) are placed in the order of shard and position.  An empty table gives no rows.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tune

CAPACITY = 4096
END_ID = 1
#: Rows of three numbers: some 10 MB as a relation.
BROADCAST_SHARDS = 200_000


class Recent(dict):
    """A cache of two generations: at its limit the older one goes; what is used again stays."""

    def __init__(self, limit: int) -> None:
        super().__init__()
        self.limit, self.old = limit, {}

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def keep(self, key: str, value: bytes) -> bytes:
        if len(self) >= self.limit:
            self.old = self.copy()
            self.clear()
        self[key] = value
        return value


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letters: bytes that print stand for themselves, the others follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in shown)}


class ChunkIds(Recent):
    """chunk -> its ids as little-endian unsigned 32-bit bytes.

    Letters of Latin-1 with at most one full stop or comma behind are one or two pre-tokens whose
    lower case and normal form need no context, so the library's BPE model is asked for their
    lower-cased letters directly; every other chunk goes through the whole tokenizer.
    """

    def __init__(self, path: str, chunks: int = 300_000, words: int = 200_000) -> None:
        super().__init__(chunks)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        self.words, self.latin = Recent(words), False
        self.stops = {c: self.whole(c) for c in ".,"}

    def of(self, text: str) -> bytes:
        """The ids of a text; lower-casing a Latin-1 text first lets more chunks share an entry.

        (Not where a special token may be spelt in capitals, which is then plain text.)
        """
        self.latin = True
        try:
            text.encode("latin-1")
            text = text if "<|" in text else text.lower()
        except UnicodeEncodeError:
            self.latin = False
        return b"".join(map(self.__getitem__, chunks_of(text)))

    def whole(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, lower: str) -> bytes:
        words = self.words
        ids = words.get(lower)
        if ids is None:
            ids = words.old.get(lower)
            if ids is None:
                shown = lower if lower.isascii() else lower.encode().decode("latin-1").translate(self.letters)
                found = [t.id for t in self.tokenize(shown)]
                ids = struct.pack(f"<{len(found)}I", *found)
            words.keep(lower, ids)
        return ids

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            stop = self.stops.get(chunk[-1:])
            body = chunk if stop is None else chunk[:-1]
            if body.isalpha() and (self.latin or body.isascii()):
                ids = self.word(body.lower()) if stop is None else self.word(body.lower()) + stop
            else:
                ids = self.whole(chunk) if chunk else b""
        return self.keep(chunk, ids)


_TABLES: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """One tokenizer per Python worker, kept from task to task; its caches last for one task."""
    if path not in _TABLES:
        _TABLES[path] = ChunkIds(path)
    return _TABLES[path]


#: The ASCII white-space characters but the space itself, each to a space.
_SPACES = {9: " ", 10: " ", 11: " ", 12: " ", 13: " "}


def chunks_of(text: str) -> list[str]:
    """What stands between ASCII white space; empty chunks have no ids."""
    rare = "\t" in text or "\r" in text or "\v" in text or "\f" in text
    return (text.translate(_SPACES) if rare else text.replace("\n", " ")).split(" ")


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, local_rank`` (and ``ids``, little-endian u32).

    ``local_rank`` counts the earlier pieces of this length in the same task.
    """
    tune(docs.sparkSession)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "local_rank", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = chunk_ids(tokenizer), defaultdict(int)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows: list[list] = [[] for _ in columns]
            index = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = table.of(text or "") + end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    index.append(i)
                    for c, v in zip(rows[1:], (p, at // 4, n, zlib.crc32(own), seen[n], own), strict=False):
                        c.append(v)
                    seen[n] += 1
            arrays = [batch.column(0).take(pa.array(index, pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:6])]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(rows[6], pa.binary())] if with_ids else []), names=columns)
        table.forget()
        table.words.forget()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, local_rank long" + (", ids binary" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


class Capacities:
    """Segment tree over remaining capacities: which of them have an open bin."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << (capacity + 1).bit_length()
        self.full = bytearray(2 * self.size)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # ranges [lo, hi) of bins

    def _mark(self, room: int, on: bool) -> None:
        k = room + self.size
        self.full[k] = on
        while k > 1:
            k //= 2
            self.full[k] = self.full[2 * k] | self.full[2 * k + 1]

    def add(self, room: int, lo: int, hi: int) -> None:
        if lo < hi:
            if not self.bins[room]:
                self._mark(room, True)
            self.bins[room].append((lo, hi))

    def take(self, room: int) -> tuple[int, int]:
        out = self.bins[room].pop()
        if not self.bins[room]:
            self._mark(room, False)
        return out

    def tightest(self, least: int) -> int:
        """The smallest remaining capacity of at least ``least`` that has an open bin, or -1."""
        k = least + self.size
        if self.full[k]:
            return least
        while k > 1:  # up to the first ancestor whose right sibling holds something, then down its left edge
            if k % 2 == 0 and self.full[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.full[2 * k] else 2 * k + 1
                return k - self.size
            k //= 2
        return -1


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows ``(length, first rank, pieces per bin, first bin, offset)`` and the number of bins.

    The n-th piece of a length belongs to the last row of the length whose first rank is <= n.
    """
    tree, plan, opened = Capacities(capacity), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, per = capacity, capacity // length
                lo, hi = opened, opened + -(-left // per)
                opened = hi
            else:
                per = room // length
                lo, hi = tree.take(room)
            need = -(-left // per)
            if hi - lo > need:
                tree.add(room, lo + need, hi)
                hi = lo + need
            n = min(left, (hi - lo) * per)
            plan.append((length, rank, per, lo, capacity - room))
            whole, rest = divmod(n, per)
            tree.add(room - per * length, lo, lo + whole)
            if rest:
                tree.add(room - rest * length, lo + whole, lo + whole + 1)
            rank, left = rank + n, left - n
    return np.array(plan, dtype=np.int64).reshape(-1, 5), opened


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, broadcast_shards: int = BROADCAST_SHARDS) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``)."""
    made = materialize(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids).withColumn("shard", F.spark_partition_id()), "pieces")
    shards = made.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = materialize(shards.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "shards")
    # a row per length and input partition: beyond the bound both sides are sorted and merged
    bases = shards.select("length", "shard", "base")
    bases = F.broadcast(bases) if shards.count() <= broadcast_shards else bases.hint("merge")
    # at most `capacity` rows, whatever the input
    counts = {r["length"]: r["n"] for r in shards.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = best_fit_plan(counts, capacity)
    # one sorted key per range: length and first rank, with the lengths' ranks laid end to end
    lengths = np.array(sorted(counts), dtype=np.int64)
    laid = np.concatenate([[0], np.cumsum([counts[n] for n in lengths.tolist()])]).astype(np.int64)
    key = laid[np.searchsorted(lengths, plan[:, 0])] + plan[:, 1]
    order = np.argsort(key)
    shared = docs.sparkSession.sparkContext.broadcast((lengths, laid, key[order], plan[order]))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, laid, key, plan = shared.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = plan[np.searchsorted(key, laid[np.searchsorted(lengths, length)] + rank, side="right") - 1] if len(length) else plan[:0]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 3] + nth // np.maximum(row[:, 2], 1), row[:, 4] + nth % np.maximum(row[:, 2], 1) * length
            out = [*batch.columns[:5], as_long(sequence), as_long(offset), *([batch.column(6)] if with_ids else [])]
            yield pa.RecordBatch.from_arrays(out, names=names)

    ranked = made.join(bases, ["length", "shard"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank"), *(["ids"] if with_ids else [])
    )
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids binary" if with_ids else ""))


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64))
