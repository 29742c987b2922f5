"""Operator 12: ranked lexical search by Block-Max WAND over compressed posting blocks.

Index (``build_index``).  Each task makes shards of the documents it reads, of about ``shard_postings`` postings, without a shuffle.
In a shard documents are numbered by ascending id, so equal scores keep the order of ids.  A term's postings are cut into
blocks of ``block`` entries; a block holds the gaps between documents and the frequencies, bit-packed at the block's
own widths, and its head tells the first and last document and where the block's bytes begin.  As N and L aren't known
while shards are made, a block's maximum impact is kept as its peaks: the (frequency, length) pairs that no other pair of
the block surpasses in both.  Of these the largest impact is exact once N and L are known.  One row per shard and term, all
terms of all documents; it is a table that serves any later queries.

Search.  For a query the cursors of its terms move over a shard by heads alone (shallow moves): between two borders
of blocks the cursors' blocks stay the same, and the sum of their maximum impacts bounds every document there.  Ranges are taken from
the highest bound down; where the bound is below the tenth best score so far, this range and all further ones are skipped, and
blocks that lie in skipped ranges alone are never decompressed.  Scores are added up in 64-bit integers.
The best of every shard meet in one ranking per item.

Items come in blocks of at most about ``block_terms`` terms; each is broadcast, and further blocks take further passes over the index.

Defined cases: null and empty texts have no terms and are never found; an item without terms finds nothing; repeated rows
are documents of their own, as are repeated items, each with its own ranking; a null doc_id comes after all others of equal
score.  Empty tables give no rows.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tune

#: ASCII letters and digits, and every byte of other characters; A-Z lower-cased, the rest ends a term.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are split at once.
SLICE = 4 << 20
NULL_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Search:
    top: int = 10
    block: int = 128
    shard_postings: int = 1_000_000
    block_terms: int = 200_000


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, a long one's in several lists."""
    data = text.encode("utf-8", "surrogatepass").translate(FOLD)
    at = 0
    while len(data) - at > SLICE:
        end = data.find(b" ", at + SLICE)
        if end < 0:
            break
        yield data[at:end].split()
        at = end
    yield data[at:].split()


def pack_bits(values: np.ndarray, widths: np.ndarray, at: np.ndarray, n_bytes: int) -> np.ndarray:
    """Bytes in which each value lies at its bit, as many bits as its width."""
    bits = np.zeros(n_bytes * 8, np.uint8)
    some = np.flatnonzero(widths > 0)
    j = 0
    while len(some):
        bits[at[some] + j] = (values[some] >> j) & 1
        j += 1
        some = some[widths[some] > j]
    return np.packbits(bits, bitorder="little")


def unpack_bits(data: np.ndarray, widths: np.ndarray, at: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(data, bitorder="little")
    out = np.zeros(len(at), np.int64)
    some = np.flatnonzero(widths > 0)
    j = 0
    while len(some):
        out[some] |= bits[at[some] + j].astype(np.int64) << j
        j += 1
        some = some[widths[some] > j]
    return out


def bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


#: A block's head: first and last document, entries, first byte in the term's data, bits of a gap and of a frequency, end of its peaks.
HEAD = 7


def blocks(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, length: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Blocks of the postings, which are sorted by term and document.

    Returns ``starts`` (each term's first posting, and the end), ``first`` (each term's first block, and the end), heads
    (one row per block), peaks (frequency and length), where a term's peaks begin, all bytes, and where a term's bytes begin.
    """
    n = len(term)
    starts = np.concatenate([np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])), [n]])
    count = np.diff(starts)
    per = -(-count // size)
    first = np.concatenate([[0], np.cumsum(per)])
    within = np.arange(n) - np.repeat(starts[:-1], count)
    block = np.repeat(first[:-1], count) + within // size
    begin = np.flatnonzero(within % size == 0)
    entries = np.diff(np.append(begin, n))
    k = within % size
    gap = np.where(k > 0, np.diff(doc, prepend=0), 0)
    gap_bits, tf_bits = bit_length(np.maximum.reduceat(gap, begin)), bit_length(np.maximum.reduceat(tf - 1, begin))
    gap_bytes, tf_bytes = -(-entries * gap_bits // 8), -(-entries * tf_bits // 8)
    at = np.concatenate([[0], np.cumsum(gap_bytes + tf_bytes)])
    wide, wide_tf = gap_bits[block], tf_bits[block]
    place = at[block] * 8 + k * wide
    place_tf = (at[:-1] + gap_bytes)[block] * 8 + k * wide_tf
    data = pack_bits(np.concatenate([gap, tf - 1]), np.concatenate([wide, wide_tf]), np.concatenate([place, place_tf]), int(at[-1]))
    # peaks: by rising length, those of a frequency above all before
    order = np.lexsort((-tf, length, block))
    b, t = block[order], tf[order]
    room = int(t.max()) + 1
    best = np.maximum.accumulate(b * room + t)
    peak = np.flatnonzero(np.concatenate([[True], best[1:] > best[:-1]]))
    peaks = np.stack([t[peak], length[order][peak]], axis=1)
    peak_end = np.cumsum(np.bincount(b[peak], minlength=len(begin)))
    term_of = np.repeat(np.arange(len(count)), per)
    peak_from = np.concatenate([[0], peak_end])[first]
    byte_from = at[first]
    heads = np.stack([doc[begin], doc[begin + entries - 1], entries, at[:-1] - byte_from[term_of], gap_bits, tf_bits, peak_end - peak_from[term_of]], axis=1)
    return starts, first, heads, peaks, peak_from, data, byte_from


#: A term's row: its heads, peaks and bytes; a shard's first row has no term, but its documents' ids and numbers of terms.
INDEX = "shard long, term binary, df long, heads binary, peaks binary, data binary"


def _binary(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


class Places(dict):
    """term -> its place, in order of first sight."""

    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


class Shard:
    """Postings of the documents read so far."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.places = Places()
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.postings = 0

    def add(self, doc_id: int | None, text: str) -> None:
        places, n, found = self.places, 0, []
        for terms in terms_of(text):
            n += len(terms)
            at = np.fromiter(map(places.__getitem__, terms), np.int64, count=len(terms))
            found.append(np.unique(at, return_counts=True))
        if not n:
            return
        term, tf = found[0]
        if len(found) > 1:
            term, at = np.unique(np.concatenate([t for t, _ in found]), return_inverse=True)
            tf = np.bincount(at, np.concatenate([c for _, c in found])).astype(np.int64)
        self.held.append((term.astype(np.int32), np.full(len(term), len(self.ids), np.int32), tf.astype(np.int64)))
        self.ids.append(NULL_ID if doc_id is None else doc_id)
        self.lengths.append(n)
        self.postings += len(term)

    def rows(self, shard: int) -> pa.RecordBatch:
        ids, lengths = np.array(self.ids, np.int64), np.array(self.lengths, np.int64)
        by_id = np.argsort(ids, kind="stable")
        number = np.empty(len(ids), np.int64)
        number[by_id] = np.arange(len(ids))
        terms = sorted(self.places)
        rank = np.empty(len(terms), np.int64)
        rank[np.fromiter((self.places[t] for t in terms), np.int64, count=len(terms))] = np.arange(len(terms))
        term, doc, tf = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held = []
        key = rank[term] * len(ids) + number[doc]
        order = np.argsort(key)
        term, doc = np.divmod(key[order], len(ids))
        starts, first, heads, peaks, peak_from, data, byte_from = blocks(term, doc, tf[order], lengths[by_id][doc], self.size)
        columns = [
            pa.array(terms, pa.binary()),
            pa.array(np.diff(starts)),
            _binary(heads.astype("<i4"), first * HEAD * 4),
            _binary(peaks.astype("<i4"), peak_from * 8),
            _binary(data, byte_from),
        ]
        whole = [pa.array([None], pa.binary()), pa.array([len(ids)]), pa.array([ids[by_id].tobytes()]), pa.array([lengths[by_id].tobytes()]), pa.array([b""])]
        body = [pa.concat_arrays([w, c]) for w, c in zip(whole, columns, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(terms) + 1, shard)), *body], names=["shard", "term", "df", "heads", "peaks", "data"])


def build_index(docs: DataFrame, p: Search | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``INDEX``, written to the shared folder, as shards are numbered by the task that makes them."""
    p = p or Search()
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, n = Shard(p.block), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    shard.add(doc_id, text)
                if shard.postings >= p.shard_postings:
                    yield from sliced(shard.rows(n))
                    shard, n = Shard(p.block), n + 1
        if shard.postings:
            yield from sliced(shard.rows(n))

    return materialize(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, INDEX), "index")


def sliced(batch: pa.RecordBatch, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def damping(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """The m of each length; whole numbers of any size."""
    some, at = np.unique(lengths, return_inverse=True)
    return np.array([100 - 75 + (75 * x * n) // total for x in some.tolist()], np.int64)[at]


class Cursor:
    """A term's blocks in a shard.  ``bound`` is known from the heads; documents and impacts only of blocks that were opened."""

    def __init__(self, heads: bytes, peaks: bytes, data: bytes, n: int, total: int, damped: np.ndarray) -> None:
        self.heads = np.frombuffer(heads, "<i4").astype(np.int64).reshape(-1, HEAD)
        self.first, self.last, self.entries, self.at, self.gap_bits, self.tf_bits, peak_end = self.heads.T
        peak = np.frombuffer(peaks, "<i4").astype(np.int64).reshape(-1, 2)
        self.bound = np.maximum.reduceat(impact(peak[:, 0], damping(peak[:, 1], n, total)), np.concatenate([[0], peak_end[:-1]]))
        self.data, self.damped = data, damped
        self.begin = np.concatenate([[0], np.cumsum(self.entries)])
        self.open = np.zeros(len(self.heads), bool)
        self.docs = self.impacts = None

    def postings(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of these blocks."""
        if self.docs is None:
            self.docs, self.impacts = np.zeros(self.begin[-1], np.int64), np.zeros(self.begin[-1], np.int64)
        new = blocks[~self.open[blocks]]
        if len(new):
            n = self.entries[new]
            start = np.cumsum(n) - n
            k = np.arange(int(n.sum())) - np.repeat(start, n)
            wide, wide_tf, at = (np.repeat(x, n) for x in (self.gap_bits[new], self.tf_bits[new], self.at[new] * 8))
            place_tf = at + np.repeat(-(-n * self.gap_bits[new] // 8) * 8, n) + k * wide_tf
            read = unpack_bits(np.frombuffer(self.data, np.uint8), np.concatenate([wide, wide_tf]), np.concatenate([at + k * wide, place_tf]))
            gaps, tf = read[: len(k)], read[len(k) :] + 1
            gaps[start] = self.first[new]
            total = np.cumsum(gaps)
            docs = total - np.repeat(total[start] - self.first[new], n)
            to = np.repeat(self.begin[new], n) + k
            self.docs[to], self.impacts[to] = docs, impact(tf, self.damped[docs])
            self.open[new] = True
        if len(blocks) == len(self.heads):
            return self.docs, self.impacts
        n = self.entries[blocks]
        to = np.repeat(self.begin[blocks] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.docs[to], self.impacts[to]


def best(cursors: list[Cursor], weights: list[int], n_docs: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` documents of highest score above 0, equal ones by number, and their scores."""
    # shallow moves: between two borders each cursor stays in one block
    ends = np.unique(np.concatenate([c.last for c in cursors]))
    begins = np.concatenate([[0], ends[:-1] + 1])
    bound, inside = np.zeros(len(ends), np.int64), []
    for c, w in zip(cursors, weights, strict=True):
        b = np.searchsorted(c.last, ends)
        there = b < len(c.last)
        there[there] = c.first[b[there]] <= ends[there]
        inside.append(np.where(there, b, -1))
        bound += np.where(there, w * c.bound[np.minimum(b, len(c.last) - 1)], 0)
    order = np.argsort(-bound, kind="stable")
    scores, size = np.zeros(n_docs, np.int64), ends - begins + 1
    docs, values = np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, at, want = 1, 0, 4 * top
    while at < len(order) and bound[order[at]] >= least:
        # as many ranges as hold `want` documents, four times as many each round
        end = at + 1 + int(np.searchsorted(np.cumsum(size[order[at + 1 :]]), want))
        taken = order[at:end]
        taken = taken[bound[taken] >= least]
        live = np.zeros(n_docs + 1, np.int64)
        np.add.at(live, begins[taken], 1)
        np.add.at(live, ends[taken] + 1, -1)
        live = np.cumsum(live)[:n_docs] > 0
        for c, w, b in zip(cursors, weights, inside, strict=True):
            blocks = np.unique(b[taken])
            blocks = blocks[blocks >= 0]
            if len(blocks):
                d, i = c.postings(blocks)
                scores[d] += w * i
        found = np.flatnonzero(live & (scores >= least))
        docs, values = np.concatenate([docs, found]), np.concatenate([values, scores[found]])
        scores[:] = 0
        keep = np.lexsort((docs, -values))[:top]
        docs, values = docs[keep], values[keep]
        if len(values) == top:
            least = max(1, int(values[-1]))
        at, want = end, want * 4
    return docs, values


@dataclass
class Queries:
    """Items ``(number, distinct terms, their weights times repeats)`` and the corpus' numbers."""

    items: list[tuple[int, list[bytes], list[int]]]
    n: int
    total: int


def search_shards(index: DataFrame, queries: Broadcast, parts: int, p: Search) -> DataFrame:
    """``(number, doc_id, score)``: the best of each shard for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = queries.value
        now, ids, damped, cursors = None, None, None, {}

        def flush() -> pa.RecordBatch:
            numbers, docs, scores = [], [], []
            for number, terms, weights in q.items:
                some = [(cursors[t], w) for t, w in zip(terms, weights, strict=True) if w and t in cursors]
                if some:
                    d, s = best([c for c, _ in some], [w for _, w in some], len(ids), p.top)
                    numbers.append(np.full(len(d), number))
                    docs.append(ids[d])
                    scores.append(s)
            number, doc, score = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (numbers, docs, scores))
            return pa.RecordBatch.from_arrays([pa.array(number), pa.array(doc, mask=doc == NULL_ID), pa.array(score)], names=["number", "doc_id", "score"])

        for batch in batches:
            for shard, term, heads, peaks, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if term is None:
                    if now is not None:
                        yield flush()
                    now, ids, cursors = shard, np.frombuffer(heads, np.int64), {}
                    damped = damping(np.frombuffer(peaks, np.int64), q.n, q.total)
                else:
                    cursors[term] = Cursor(heads, peaks, data, q.n, q.total, damped)
        if now is not None:
            yield flush()

    # a shard's row without a term comes first
    placed = index.select("shard", "term", "heads", "peaks", "data").repartition(parts, "shard").sortWithinPartitions("shard", "term")
    return placed.mapInArrow(run, "number long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, p: Search | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per item and document among its best: ``item_id, rank, doc_id, score``."""
    p = p or Search()
    return search(build_index(docs, p, id_col, text_col), items, p, item_col, item_text)


def search(index: DataFrame, items: DataFrame, p: Search, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rankings of all items from an index."""
    spark = index.sparkSession

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(np.frombuffer(x.as_buffer(), np.int64).sum()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int64())], names=["terms"])

    whole = index.where("term IS NULL")
    n = whole.agg(F.sum("df")).first()[0] or 0
    total = whole.select("peaks").mapInArrow(lengths, "terms long").agg(F.sum("terms")).first()[0] or 0
    shards = whole.count()
    parts = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    numbered = materialize(rows.withColumn("number", F.monotonically_increasing_id()), "items")
    size = numbered.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    blocks = max(1, -(-size // p.block_terms))
    found = None
    for b in range(blocks if n else 0):
        wanted: dict[int, dict[bytes, int]] = {}
        for r in numbered.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b).toLocalIterator():
            times = wanted.setdefault(r["number"], {})
            for terms in terms_of(r["text"]):
                for t in terms:
                    times[t] = times.get(t, 0) + 1
        every = sorted({t for times in wanted.values() for t in times})
        if not every:
            continue
        asked = F.broadcast(spark.createDataFrame([(bytearray(t),) for t in every], "term binary"))
        some = index.join(asked, "term", "left_semi")
        df = {bytes(r["term"]): r["df"] for r in some.groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator()}
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for t, c in df.items()}
        listed = [(k, list(times), [c * weight.get(t, 0) for t, c in times.items()]) for k, times in wanted.items()]
        shared = spark.sparkContext.broadcast(Queries(listed, n, total))
        best_of = search_shards(some.select(*index.columns).unionByName(whole), shared, parts, p)
        if blocks > 1:
            # written before the next block comes, so one is held at a time
            best_of = materialize(best_of, "best", small=True)
            shared.destroy()
        found = best_of if found is None else found.unionByName(best_of)
    if found is None:
        found = spark.createDataFrame([], "number long, doc_id long, score long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.top)
    return ranked.join(numbered.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")
