"""Operator 6: benchmark items found in documents by word pair seeds and local alignment.

Alignment.  Smith-Waterman over words (match 2, mismatch -1, gap -1) scores an item's copy in a document.
A pair is told where the score reaches half of a full copy's or 50 words match.
Seeds.  They find every copy that the alignment accepts.  With a score of at least n (the item's words) m
matches hold at most 2m - n errors, so of the m - 1 steps from match to match those without an error (x0)
and with one (x1) obey 2 x0 + x1 >= n - 2.  Such a step shows as two words of the item, neighbours or one apart,
that are neighbours or one apart in the document.  Each kept step weighs 2 or 1, a step dropped costs 2 of
the bound: a third of the steps, those of the most frequent words, is dropped and the rest must
still weigh enough among hits whose diagonals differ by no more than the errors allow.  50 matches of n words
leave out n - 50, so single words find those: 40 are dropped and 10 of the rest must hit.  Words are counted in
all documents; which steps are dropped changes the cost and no result.
A window round such hits holds the whole alignment, which is made row by row in memory linear in the window.  It is passed over only where the words it shares with
the item can't reach the decision (an exact bound).

Items come in blocks of at most ``block_words`` words; each block is broadcast and its size is bounded by
that.  Further blocks take further passes over the documents, one block held at a time, and nothing is dropped.

Defined cases: null or empty texts match nothing; items of fewer than five words are no evidence and
never match; rows with a null id are searched and told with that id; repeated rows give repeated
results, as do repeated item ids with their own texts; ties in score keep the first place.  Empty tables
give no rows.  Columns other than ids and texts are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULTIPLIER, Among, WordHash, as_i64, batch_words, materialize, mix64, text_hash, tune, words_of


@dataclass(frozen=True)
class Decontamination:
    least_words: int = 5
    share: float = 0.5
    long_match: int = 50
    match: int = 2
    mismatch: int = -1
    gap: int = 1
    block_words: int = 1_000_000

    def __post_init__(self) -> None:
        if self.match > 2 * self.error or self.least_words * self.share * self.match < 3 * self.error:
            raise ValueError("seeds find every accepted copy only where two errors cost a match and a copy's score three errors")

    @property
    def error(self) -> int:
        """The least that an error costs."""
        return min(-self.mismatch, self.gap)


#: A cell holds its score times this and the words matched so far, so of equal scores the one with more matches wins.
UNIT = 1 << 24


def _rows(item: np.ndarray, text: np.ndarray, p: Decontamination, free: bool) -> Iterator[np.ndarray]:
    """The alignment's rows one after the other, two held at a time.

    ``free``: it may begin anywhere (cells of no score are 0); else it begins where both do.
    """
    gap = p.gap * UNIT
    ramp = gap * np.arange(len(text) + 1, dtype=np.int64)
    row = np.zeros(len(text) + 1, np.int64) if free else -ramp
    for i, word in enumerate(item):
        new = np.empty_like(row)
        new[0] = 0 if free else -(i + 1) * gap
        np.maximum(row[:-1] + np.where(text == word, p.match * UNIT + 1, p.mismatch * UNIT), row[1:] - gap, out=new[1:])
        if free:
            new[new < UNIT] = 0
        # gaps in the item: the best earlier cell of the row, less its distance
        row = np.maximum.accumulate(new + ramp) - ramp
        if free:
            row[row < UNIT] = 0
        yield row


def align(item: np.ndarray, text: np.ndarray, p: Decontamination) -> tuple[int, int, int, int]:
    """Smith-Waterman with linear gaps: score, matched words, start and end (exclusive) in the text.

    Memory is linear: the end is where the best cell is, and the start is found by aligning backwards from it.
    """
    best, last, end = 0, 0, 0
    for i, row in enumerate(_rows(item, text, p, True)):
        k = int(row.argmax())
        if row[k] > best:
            best, last, end = int(row[k]), i + 1, k
    if not best:
        return 0, 0, 0, 0
    score, matched = divmod(best, UNIT)
    # the words of the text beyond the item's cost a gap each, and all gaps less than the matches bring
    reach = min(end, last + p.match * last // p.gap)
    for row in _rows(item[:last][::-1], text[end - reach : end][::-1], p, False):
        found = np.flatnonzero(row == best)
        if len(found):
            return score, matched, end - int(found[0]), end
    raise AssertionError("an alignment has a start")


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of two words each, in order."""
    with np.errstate(over="ignore"):
        return mix64(a * MULTIPLIER + b)


@dataclass
class Seeds:
    """Sorted ``keys``; the places of the i-th are those from ``starts[i]`` on, each in item ``item`` at word ``at``."""

    keys: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    at: np.ndarray
    adjacent: np.ndarray

    @classmethod
    def of(cls, places: list[tuple[np.ndarray, int, np.ndarray, bool]]) -> "Seeds":
        keys = np.concatenate([k for k, *_ in places] or [np.zeros(0, np.uint64)])
        order = np.argsort(keys, kind="stable")
        unique, starts = np.unique(keys[order], return_index=True)
        columns = ([np.full(len(k), i) for k, i, _, _ in places], [at for _, _, at, _ in places], [np.full(len(k), a) for k, _, _, a in places])
        item, at, adjacent = (np.concatenate(c or [np.zeros(0, np.int64)])[order] for c in columns)
        return cls(unique, np.append(starts, len(keys)), item, at, adjacent.astype(bool))

    def times(self, values: np.ndarray) -> int:
        """How many seed places the keys ``values`` have."""
        key = np.searchsorted(self.keys, values)
        return int((self.starts[key + 1] - self.starts[key]).sum())

    def of_items(self, first: int, end: int) -> "Seeds":
        """Those of a range of items, which are numbered anew."""
        keep = (self.item >= first) & (self.item < end)
        keys, starts = np.unique(np.repeat(self.keys, np.diff(self.starts))[keep], return_index=True)
        return Seeds(keys, np.append(starts, int(keep.sum())), self.item[keep] - first, self.at[keep], self.adjacent[keep])

    def hits(self, found: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the text's places ``found`` with the keys ``values``: text places and seed places, all pairs."""
        key = np.searchsorted(self.keys, values)
        n = self.starts[key + 1] - self.starts[key]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(found, n), np.repeat(self.starts[key], n) + inner


@dataclass
class Items:
    """One block of items: their word hashes, and after counting the seeds and what they must weigh."""

    ids: list
    words: list[np.ndarray]
    pairs: Seeds | None = None
    singles: Seeds | None = None
    need: np.ndarray | None = None
    band: np.ndarray | None = None

    def all_words(self) -> np.ndarray:
        return np.unique(np.concatenate(self.words))

    def choose(self, known: np.ndarray, often: np.ndarray, p: Decontamination) -> None:
        """Drop the steps and single words of the most frequent words, as many as the bounds allow."""
        pairs, singles, need, band = [], [], [], []
        for k, w in enumerate(self.words):
            n = len(w)
            full = p.share * p.match * n
            total = math.ceil(full / p.error) - 2
            drop = (total - 1) // 3
            need.append(total - 2 * drop)
            band.append(math.floor((p.match * n - full) / p.error))
            f = often[np.searchsorted(known, w)].astype(np.float64) + 1
            # a step begins at a word and ends at the next one or the one after it
            cost = f[:-1] * (f[1:] + np.append(f[2:], 0))
            keep = np.sort(np.argsort(cost, kind="stable")[: n - 1 - drop])
            pairs.append((pair(w[keep], w[keep + 1]), k, keep, True))
            keep = keep[keep < n - 2]
            pairs.append((pair(w[keep], w[keep + 2]), k, keep, False))
            if n >= p.long_match:
                keep = np.sort(np.argsort(f, kind="stable")[: n - (p.long_match - self.least_singles(p))])
                singles.append((w[keep], k, keep, False))
        self.pairs, self.singles = Seeds.of(pairs), Seeds.of(singles)
        self.need, self.band = np.array(need), np.array(band)

    def part(self, first: int, end: int) -> "Items":
        return Items(self.ids[first:end], self.words[first:end], self.pairs.of_items(first, end), self.singles.of_items(first, end), self.need[first:end], self.band[first:end])

    def among(self) -> tuple[Among, Among]:
        return Among(self.pairs.keys), Among(self.singles.keys)

    @staticmethod
    def least_singles(p: Decontamination) -> int:
        return max(1, p.long_match // 5)


def _dense(doc: np.ndarray, item: np.ndarray, diagonal: np.ndarray, weight: np.ndarray, band: np.ndarray, need: np.ndarray, room: int) -> tuple[np.ndarray, ...]:
    """``(doc, item, diagonal)`` of hits from which on, over the item's ``band`` of diagonals, enough weight lies."""
    wide = room + 2 * int(band.max(initial=0)) + 2
    place = (doc * len(band) + item) * wide + diagonal
    order = np.argsort(place, kind="stable")
    doc, item, diagonal, place = doc[order], item[order], diagonal[order], place[order]
    total = np.concatenate([[0], np.cumsum(weight[order])])
    end = np.searchsorted(place, place + band[item], side="right")
    ok = total[end] - total[:-1] >= need[item]
    return doc[ok], item[ok], diagonal[ok]


#: Hits that are laid out at once, each in some ten arrays.
HITS = 1_000_000


def candidates(words: np.ndarray, starts: np.ndarray, items: Items, among: tuple[Among, Among], p: Decontamination) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Per text of the batch and item: the windows of the text that may hold a copy, in order and apart."""
    windows: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    _search(words, starts, np.diff(starts), items, among, p, 0, 0, 0, windows)
    out = {}
    for key in sorted(windows):
        merged: list[tuple[int, int]] = []
        for a, b in sorted(set(windows[key])):
            if merged and a <= merged[-1][1]:
                merged[-1] = merged[-1][0], max(b, merged[-1][1])
            else:
                merged.append((a, b))
        out[key] = merged
    return out


def _search(words: np.ndarray, starts: np.ndarray, length: np.ndarray, items: Items, among: tuple[Among, Among], p: Decontamination, doc0: int, item0: int, word0: int, windows: dict) -> None:
    """Windows of these texts and items, whose numbers and first words are told.

    Where words repeat, texts and items have very many hits.  Beyond ``HITS`` the texts are taken one by one, then in pieces, then the
    items in halves.  All hits of a copy lie within ``reach`` words, by which pieces overlap, so each is whole in one of them.
    """
    if not len(items.words):
        return
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    found = []
    for step in (1, 2):
        keys = pair(words[:-step], words[step:])
        at = among[0](keys)
        at = at[text[at] == text[at + step]]
        found.append((step, at, keys[at]))
    at = among[1](words) if len(items.singles.keys) else np.zeros(0, np.int64)
    found.append((0, at, words[at]))
    sizes = np.array([len(w) for w in items.words])
    loose = p.match * sizes // p.error  # errors of an alignment with a score cost less than its matches bring
    reach = int((sizes + np.maximum(items.band, loose)).max()) + 2
    if sum((items.pairs if step else items.singles).times(values) for step, _, values in found) > HITS:
        if len(starts) > 2:
            for i in range(len(starts) - 1):
                _search(words[starts[i] : starts[i + 1]], np.array([0, starts[i + 1] - starts[i]]), length[i : i + 1], items, among, p, doc0 + i, item0, word0, windows)
            return
        if len(words) > 4 * reach:
            half = len(words) // 2
            for a, b in ((0, half + reach), (half, len(words))):
                _search(words[a:b], np.array([0, b - a]), length, items, among, p, doc0, item0, word0 + a, windows)
            return
        if len(sizes) > 1:
            half = len(sizes) // 2
            for a, b in ((0, half), (half, len(sizes))):
                part = items.part(a, b)
                _search(words, starts, length, part, part.among(), p, doc0, item0 + a, word0, windows)
            return
    most = int(sizes.max())
    room = len(words) + 2 * most
    docs, own, diagonals, weights = [], [], [], []
    dense = []
    for step, at, values in found:
        seeds = items.pairs if step else items.singles
        at, seed = seeds.hits(at, values)
        # no diagonal is below minus the item's length
        diagonal = at - starts[text[at]] - seeds.at[seed] + most
        if step:
            docs.append(text[at])
            own.append(seeds.item[seed])
            diagonals.append(diagonal)
            weights.append(np.where(seeds.adjacent[seed] & (step == 1), 2, 1))
        elif len(at):
            need = np.full(len(sizes), items.least_singles(p))
            dense.append((_dense(text[at], seeds.item[seed], diagonal, np.ones(len(at), np.int64), loose, need, room), loose))
    dense.append((_dense(*(np.concatenate(x) for x in (docs, own, diagonals, weights)), items.band, items.need, room), items.band))
    for (doc, item, diagonal), band in dense:
        lo = np.maximum(0, word0 + diagonal - most - band[item])
        hi = np.minimum(length[doc], word0 + diagonal - most + sizes[item] + band[item])
        # neighbours on the diagonals make one window
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1])])[: len(doc)])
        if len(new):
            top = np.maximum.reduceat(hi, new)
            for d, k, a, b in zip(*(x.tolist() for x in (doc[new], item[new], lo[new], top)), strict=True):
                windows[doc0 + d, item0 + k].append((a, b))


def match(words: np.ndarray, windows: list[tuple[int, int]], k: int, items: Items, p: Decontamination) -> tuple[object, int, int, int, int, int] | None:
    """``(item id, score, matched, item words, start, end)`` of the item's best place in the windows, if it is found."""
    item, best = items.words[k], None
    full = p.share * p.match * len(item)
    bag, sorted_words = Counter(item.tolist()), np.unique(item)
    for lo, hi in windows:
        text = words[lo:hi]
        shared = sum((Counter(text[_member(sorted_words, text)].tolist()) & bag).values())
        if p.match * shared < full and shared < p.long_match:
            continue
        score, matched, a, b = align(item, text, p)
        if (score >= full or matched >= p.long_match) and (best is None or score > best[1]):
            best = (items.ids[k], score, matched, len(item), lo + a, lo + b)
    return best


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


def _blocks(items: DataFrame, id_col: str, text_col: str, p: Decontamination) -> Iterator[Items]:
    """The items in blocks of bounded size, one held at a time."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"] or 0
    n = max(1, -(-total // p.block_words))
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        table, ids, words = WordHash(), [], []
        for r in part.toLocalIterator():
            w = words_of(r["text"])
            if len(w) >= p.least_words:
                ids.append(r["item_id"])
                words.append(table.of(w))
        if ids:
            yield Items(ids, words)


def decontaminate(docs: DataFrame, items: DataFrame, p: Decontamination | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document and item found in it: ``doc_id, text_hash, item_id, score, matched, item_words, start_word, end_word``.

    ``score`` is the alignment's share of a full copy's score.
    """
    p = p or Decontamination()
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_hash(text_col).alias("text_hash"))
    schema = "doc_id long, text_hash long, item_id long, score double, matched long, item_words long, start_word long, end_word long"
    result, blocks = spark.createDataFrame([], schema), _blocks(items, item_col, item_text, p)
    block = next(blocks, None)
    while block is not None:
        known = spark.sparkContext.broadcast(block.all_words())

        def count(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            table, among = WordHash(), Among(known.value)
            n = np.zeros(len(known.value), np.int64)
            for batch in batches:
                words = batch_words(batch.column(1).to_pylist(), table)[0]
                n += np.bincount(np.searchsorted(known.value, words[among(words)]), minlength=len(n))
            yield pa.RecordBatch.from_arrays([as_i64(known.value), pa.array(n)], names=["word", "n"])

        # at most one row per word of the block
        counted = rows.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        often = np.zeros(len(known.value), np.int64)
        for r in materialize(counted, "seeds", small=True).toLocalIterator():
            often[np.searchsorted(known.value, np.uint64(r["word"] % 2**64))] = r["n"]
        block.choose(known.value, often, p)
        known.destroy()
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            table, among = WordHash(), (Among(items.pairs.keys), Among(items.singles.keys))
            for batch in batches:
                words, starts = batch_words(batch.column(1).to_pylist(), table)
                found = []
                for (i, k), windows in candidates(words, starts, items, among, p).items():
                    got = match(words[starts[i] : starts[i + 1]], windows, k, items, p)
                    if got:
                        found.append((i, *got))
                i, item, score, matched, size, start, end = zip(*found, strict=True) if found else ((),) * 7
                ints = [pa.array(x, pa.int64()) for x in (matched, size, start, end)]
                share = pa.array([s / (p.match * n) for s, n in zip(score, size, strict=True)], pa.float64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(i, pa.int64())) for c in (0, 2)), pa.array(item, pa.int64()), share, *ints], names=["doc_id", "text_hash", "item_id", "score", "matched", "item_words", "start_word", "end_word"])

        found, block = rows.mapInArrow(search, schema), next(blocks, None)
        if block is not None:
            # written before the next block comes, so the broadcast of one block is held at a time
            found = materialize(found, "found")
            shared.destroy()
        result = result.unionByName(found)
    return result
