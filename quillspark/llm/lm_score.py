"""Operator 9: language-model scores from a log-frequency Bloom filter.

Counting.  Each training document gives its tokens (words and one end) and its bigrams (the end of
a document is the context of the next one's first word), all of them, those seen once too.  Workers
combine a portion's counts and send them, sorted, in one block for each range of keys, so the
shuffle moves a few large rows; where a range's blocks meet, its sums are made and its part of the filter is
built at once.  N and V are exact.

Filter (Talbot and Osborne, 2007).  A count c is quantised to q = 1 + floor(log2 c); the filter holds
the gram with each of 1..q, and a count is read back by probing 1, 2, ... until a probe misses.  Levels above the first, of
which there are few, have ``higher_probes`` bits each and as much more room, so that a count is seldom read too high.  It consists of segments: equal ranges of the whole gram's hash, so that no word makes one large.  Their number is
that of the training text in units of ``segment_bytes``; each takes ``bits`` bits for an item of ``probes`` probes, at any size.

Score.  p(w|v) = (min(c(vw), c(v), c(w)) + mu p(w)) / (c(v) + mu) with p(w) = min(1, (c(w) + 1) / (N + V + 1)), all c from
probes; the text's score is the sum of log10 p.  A bigram is no more frequent than its words, so whatever a probe says falsely no p exceeds 1.
Base.  The sum of log10((c+1) / (N+V+1)) over tokens with exact c.

Size.  Up to ``large_bytes`` of training text both filters (words, bigrams) and the exact counts of words are broadcast.  A filter over
``filter_bytes`` is used in shards, runs of segments within that size.  Each pass over the texts has one shard of bigrams and one of words for
either place broadcast; it adds the tokens whose word, context and bigram fall to them.  Its sums are written and its shards released before the
next ones come.  Beyond that size, or where there would be more than ``passes`` shards of bigrams or ``broadcast_words`` words, nothing is broadcast: texts
are read once and written as portions of numbered words; a portion sends its distinct grams, counted, by ranges of the hash; the task that has a range builds its segments,
probes them once for each gram that was sent, and answers each portion with levels and exact counts; answers meet their portion, and its texts are
scored.  A gram moves once a portion and its answer once, whatever the filters' size.  No size changes a score.

Defined cases: a null or empty text is one end token.  Rows repeated with one doc_id are counted and
scored each.  A null doc_id trains and isn't held out.  With no training document c, N and V are 0.
Empty tables give no rows.  Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MULTIPLIER, as_i64, made, materialize, mix64, release, tune

ONE = np.uint64(1)
#: The highest level probed: counts stay below 2^48.
TOP = 48
#: The end of a text as a token; no word is empty.
END, END_KEY = b"", np.uint64(0x5851F42D4C957F2C)
WORDS, BIGRAMS, EXACT = 0, 1, 2
#: Bytes of a filter that the driver fetches at once.
FETCH = 16 << 20


@dataclass(frozen=True)
class LanguageModel:
    fold: int = 7
    held: int = 2
    mu: float = 20.0
    bits: int = 10
    probes: int = 6
    higher_probes: int = 8
    segment_bytes: int = 1 << 20
    #: Training text whose grams meet in one task.
    task_bytes: int = 8 << 20
    waves: int = 8
    range_bytes: int = 32 << 20
    filter_bytes: int = 128 << 20
    #: Shards of bigrams up to which texts are read anew for each, and words up to which their exact counts are broadcast.
    passes: int = 3
    broadcast_words: int = 6_000_000
    #: Training text beyond which nothing is broadcast, and words of a portion then.
    large_bytes: int = 64 << 20
    large_portion: int = 1_000_000
    #: Tokens that a worker counts together; it scores half as many together, as it holds the filters then.
    portion: int = 400_000


class Words(dict):
    """word -> its place in ``keys``, the even 64-bit hashes of the words met; the end has place 0."""

    LIMIT = 100_000

    def __init__(self) -> None:
        super().__init__()
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.keys, self.new = np.array([END_KEY]), []
        self[END] = 0

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        n = self[word] = len(self)
        return n

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places of all tokens, each text's end included, and tokens per text."""
        from xxhash import xxh3_64_intdigest

        flat: list[bytes] = []
        starts = [0]
        for text in texts:
            flat += text.lower().split()
            flat.append(END)
            starts.append(len(flat))
        out = np.fromiter(map(self.__getitem__, flat), np.int64, count=len(flat))
        if self.new:
            more = np.fromiter(map(xxh3_64_intdigest, self.new), np.uint64, count=len(self.new))
            self.keys, self.new = np.concatenate([self.keys, more & ~ONE]), []
        return out, np.diff(starts)


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def before(tokens: np.ndarray) -> np.ndarray:
    """Each token's context; that of a text's first word is an end, as is what stands before it."""
    return np.concatenate([[0], tokens[:-1]]) if len(tokens) else tokens


def bigram_keys(words: Words, tokens: np.ndarray) -> np.ndarray:
    """Odd keys of the bigrams that end in each token."""
    with np.errstate(over="ignore"):
        return mix64(words.keys[before(tokens)] * MULTIPLIER + words.keys[tokens]) | ONE


def prefix(keys: np.ndarray, bits: int) -> np.ndarray:
    """The first ``bits`` bits of each key as a number."""
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def portions(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[tuple[list[pa.RecordBatch], list[bytes]]]:
    """Batches put together until they hold about ``size`` words."""
    held, texts, n = [], [], 0
    for batch in batches:
        more = [as_bytes(t) for t in batch.column(column).to_pylist()]
        held.append(batch)
        texts += more
        n += sum(map(len, more)) // 6
        if n >= size:
            yield held, texts
            held, texts, n = [], [], 0
    if texts:
        yield held, texts


def runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    cut = np.flatnonzero(np.diff(x)) + 1
    edges = [0, *cut.tolist(), len(x)] if len(x) else []
    return zip(edges, edges[1:], strict=False)


def quantised(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c) for c >= 1."""
    return np.frexp(counts.astype(np.float64))[1]


def expected(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts that a level stands for; 0 for none."""
    return np.where(levels > 0, (3 * 2.0 ** (levels - 1) - 1) / 2, 0.0)


def _hashes(keys: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit hashes of an item, a gram with a level."""
    with np.errstate(over="ignore"):
        g = mix64(keys + np.asarray(level).astype(np.uint64) * MULTIPLIER)
    return g & np.uint64(0xFFFFFFFF), (g >> np.uint64(32)) | ONE


def _place(a: np.ndarray, b: np.ndarray, i: int, size: np.ndarray) -> np.ndarray:
    """The item's i-th place in a segment of ``size`` bits, below 2^32."""
    return ((((a + np.uint64(i) * b) & np.uint64(0xFFFFFFFF)) * size) >> np.uint64(32)).astype(np.int64)


def segments(keys: np.ndarray, counts: np.ndarray, bits: int, p: LanguageModel) -> Iterator[tuple[int, int, int, int, bytes]]:
    """``(segment, size in bits, grams, their sum, bitmap)`` of sorted keys."""
    seg, level = prefix(keys, bits), quantised(counts)
    cuts = list(runs(seg))
    # as many bits a probe on every level, so that equal shares of them are set
    items = [(b - a) * p.probes + (int(level[a:b].sum()) - (b - a)) * p.higher_probes for a, b in cuts]
    sizes = np.array([max(8, -(-n * p.bits // (8 * p.probes)) * 8) for n in items], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    of = np.repeat(np.arange(len(cuts)), [b - a for a, b in cuts])
    data = np.zeros(starts[-1], bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        some = np.flatnonzero(level >= q)
        a, b = _hashes(keys[some], q)
        start, size = starts[of[some]], sizes[of[some]].astype(np.uint64)
        for i in range(p.probes if q == 1 else p.higher_probes):
            data[start + _place(a, b, i, size)] = True
    packed = np.packbits(data, bitorder="little")
    for k, (a, b) in enumerate(cuts):
        yield int(seg[a]), int(sizes[k]), b - a, int(counts[a:b].sum()), packed[starts[k] // 8 : starts[k + 1] // 8].tobytes()


def dealt(rows: DataFrame, size: int, bits: int, p: LanguageModel) -> tuple[int, int]:
    """Tasks for this much training text, and the bits of a range of keys, of which each is of whole segments and held by a task at a time.

    Tasks are at most ``waves`` times the cores (or the session's partitions); four to eight ranges a task deal them out evenly,
    more where a range would have over ``range_bytes`` of text.
    """
    least, cores = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(least, min(-(-size // p.task_bytes), p.waves * cores))
    ranges = min(bits, max(1, (max(4 * tasks, -(-size // p.range_bytes)) - 1).bit_length()))
    return min(tasks, 1 << ranges), ranges


def build(training: DataFrame, size: int, bits: int, p: LanguageModel) -> DataFrame:
    """``(kind, seg, size, grams, total, data)``: the segments of words and of bigrams, and blocks of exact counts.

    A block's ``data`` are the keys of words followed by their counts, 8 bytes each.
    """
    tasks, ranges = dealt(training, size, bits, p)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for _, texts in portions(batches, 0, p.portion):
            if len(words) > Words.LIMIT:
                words.forget()
            tokens, _ = words.tokens(texts)
            once = np.bincount(tokens, minlength=len(words.keys))
            order = np.argsort(words.keys)
            order = order[once[order] > 0]
            out = []
            for keys, n in ((words.keys[order], once[order]), np.unique(bigram_keys(words, tokens), return_counts=True)):
                part = prefix(keys, ranges)
                out += [(int(part[a]), keys[a:b].tobytes(), n[a:b].astype("<i8").tobytes()) for a, b in runs(part)]
            part, keys, n = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(keys, pa.binary()), pa.array(n, pa.binary())], names=["part", "keys", "n"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> pa.RecordBatch:
            keys, n = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*held, strict=True), ("<u8", "<i8"), strict=True))
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, n = keys[first], np.add.reduceat(n, first)
            rows = []
            for kind in (WORDS, BIGRAMS):
                own = (keys & ONE) == kind
                rows += [(kind, *x) for x in segments(keys[own], n[own], bits, p)]
            own = (keys & ONE) == WORDS
            rows.append((EXACT, now, 0, int(own.sum()), 0, keys[own].tobytes() + n[own].tobytes()))
            cols = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), *[pa.int64()] * 4, pa.binary()), strict=True)], names=["kind", "seg", "size", "grams", "total", "data"])

        for batch in batches:
            for part, keys, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and part != now:
                    yield flush()
                    held = []
                now = part
                held.append((keys, n))
        if held:
            yield flush()

    blocks = training.select("text").mapInArrow(count, "part long, keys binary, n binary")
    placed = blocks.repartition(tasks, "part").sortWithinPartitions("part")
    return placed.mapInArrow(make, "kind int, seg long, size long, grams long, total long, data binary")


@dataclass
class LogBloom:
    """A run of segments laid end to end from number ``first`` on; ``starts`` are their first bits, in all ``2^bits`` segments."""

    data: np.ndarray
    starts: np.ndarray
    first: int
    bits: int
    probes: int
    higher_probes: int

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Which keys fall to these segments."""
        at = prefix(keys, self.bits) - self.first
        return (at >= 0) & (at < len(self.starts) - 1)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The highest level up to which every probe hits; all keys fall to these segments."""
        at = prefix(keys, self.bits) - self.first
        start, size = self.starts[at], (self.starts[at + 1] - self.starts[at]).astype(np.uint64)
        out = np.zeros(len(keys), np.int64)
        alive, level = np.flatnonzero(size > 0), 1
        while len(alive) and level <= TOP:
            a, b = _hashes(keys[alive], level)
            base, room = start[alive], size[alive]
            hit = self._bit(base + _place(a, b, 0, room))
            alive, a, b, base, room = (x[hit] for x in (alive, a, b, base, room))
            probes = self.probes if level == 1 else self.higher_probes
            hit = self._bit(base + _place(a, b, 1, room)) if probes > 1 else np.ones(len(alive), bool)
            for i in range(2, probes):
                hit &= self._bit(base + _place(a, b, i, room))
            alive = alive[hit]
            out[alive] = level
            level += 1
        return out

    def _bit(self, at: np.ndarray) -> np.ndarray:
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def shards(built: DataFrame, kind: int, bits: int, limit: int) -> list[tuple[int, int]]:
    """Runs of segments ``(first, end)`` of at most ``limit`` bytes each; a single segment may stand alone.

    Runs are equal ranges of the hash, so only a sum for each comes to the driver.
    """
    own, cut = built.where(F.col("kind") == kind), 0
    while True:
        sums = own.groupBy(F.shiftright("seg", bits - cut).alias("run")).agg(F.sum("size").alias("bits")).collect()
        most = max((r["bits"] for r in sums), default=0) / 8
        if most <= limit or cut == bits:
            step = 1 << (bits - cut)
            return [(k * step, (k + 1) * step) for k in range(1 << cut)]
        cut = min(bits, cut + max(1, int(most / limit).bit_length() - 1))


def load(built: DataFrame, kind: int, first: int, end: int, bits: int, p: LanguageModel) -> LogBloom:
    """The segments from ``first`` up to ``end``, whose total size is bounded, fetched in parts."""
    own = built.where((F.col("kind") == kind) & (F.col("seg") >= first) & (F.col("seg") < end))
    sizes = np.zeros(end - first, np.int64)
    listed = own.select("seg", "size").toArrow()
    sizes[listed["seg"].to_numpy() - first] = listed["size"].to_numpy()
    starts = np.concatenate([[0], np.cumsum(sizes)])
    data = np.zeros(max(1, starts[-1] // 8), np.uint8)
    step = max(1, (end - first) // max(1, -(-len(data) // FETCH)))
    for low in range(first, end, step):
        part = own.where((F.col("seg") >= low) & (F.col("seg") < low + step)).select("seg", "data").toArrow()
        for seg, bitmap in zip(part["seg"].to_pylist(), part["data"], strict=True):
            at = starts[seg - first] // 8
            held = np.frombuffer(bitmap.as_buffer(), np.uint8)
            data[at : at + len(held)] = held
    return LogBloom(data, starts, first, bits, p.probes, p.higher_probes)


def exact_counts(built: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All words' keys in order and their counts; the caller has bounded their number."""
    blocks = [np.frombuffer(x.as_buffer(), np.uint64) for x in built.where(F.col("kind") == EXACT).select("data").toArrow()["data"]]
    none = [np.zeros(0, np.uint64)]
    keys, n = (np.concatenate([half(x) for x in blocks] or none) for half in (lambda x: x[: len(x) // 2], lambda x: x[len(x) // 2 :]))
    order = np.argsort(keys)
    return keys[order], n[order].astype(np.uint32 if n.max(initial=0) < 2**32 else np.uint64)


SUMS = ["n_tokens", "n_known", "base_score", "score"]
PART = "doc_id long, text_hash long, n_tokens long, n_known long, base_score double, score double"


@dataclass
class Portion:
    """Tokens of some rows with what the filters of words say of them."""

    ids: pa.Array
    prints: pa.Array
    length: np.ndarray
    keys: np.ndarray
    #: Per token: whether its word and its context fall to the shards, and the levels of both there.
    own: np.ndarray
    level: np.ndarray
    context: np.ndarray
    known: np.ndarray
    base: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.length) - self.length


def log_p(joint: np.ndarray, level: np.ndarray, context: np.ndarray, total: float, p: LanguageModel) -> np.ndarray:
    """log10 p(w|v) of a bigram's count and the levels of its word and context."""
    word, before = expected(level), expected(context)
    mass = p.mu * np.minimum(1.0, (word + 1) / total)
    return np.log10(np.minimum(joint, np.minimum(word, before)) + mass) - np.log10(before + p.mu)


def read_portions(batches: Iterator[pa.RecordBatch], words: LogBloom, contexts: LogBloom, exact: tuple, total: float, p: LanguageModel) -> Iterator[Portion]:
    from xxhash import xxh3_64_intdigest

    def levels(bloom: LogBloom, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        here, out = bloom.holds(keys), np.zeros(len(keys), np.uint8)
        out[here] = bloom.levels(keys[here])
        return here, out

    seen = Words()
    none = [np.zeros(0, t) for t in (bool, np.uint8, bool, np.uint8, np.int64, float)]
    told = none
    for held, texts in portions(batches, 1, p.portion // 2):
        if len(seen) > Words.LIMIT:
            seen.forget()
            told = none
        tokens, length = seen.tokens(texts)
        keys = seen.keys[len(told[0]) :]
        if len(keys):  # words that are new to this worker
            c = np.zeros(len(keys))
            if len(exact[0]):
                k, n = exact
                at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
                c = np.where(k[at] == keys, n[at], 0).astype(float)
            word = levels(words, keys)
            new = (*word, *(word if contexts is words else levels(contexts, keys)), (c > 0).astype(np.int64), np.log10((c + 1) / total))
            told = [np.append(x, y) for x, y in zip(told, new, strict=True)]
        here, level, there, context, known, base = told
        v = before(tokens)
        prints = np.fromiter(map(xxh3_64_intdigest, texts), np.uint64, count=len(texts))
        ids = pa.concat_arrays([b.column(0) for b in held])
        yield Portion(ids, as_i64(prints), length, bigram_keys(seen, tokens), here[tokens] & there[v], level[tokens], context[v], known[tokens], base[tokens])


def one_pass(rows: DataFrame, words: Broadcast, contexts: Broadcast, pairs: Broadcast, exact: Broadcast, first: bool, total: float, p: LanguageModel) -> DataFrame:
    """Sums of the tokens whose word, context and bigram fall to the broadcast shards, per row.

    ``first``: tokens and exact counts are told.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in read_portions(batches, words.value, words.value if contexts is words else contexts.value, exact.value, total, p):
            pair, at = np.unique(x.keys, return_inverse=True)
            joint, here = np.zeros(len(pair)), pairs.value.holds(pair)
            joint[here] = expected(pairs.value.levels(pair[here]))
            logs = log_p(joint[at], x.level, x.context, total, p)
            logs[~(x.own & here[at])] = 0.0
            told = [x.length, *(np.add.reduceat(v, x.starts) for v in (x.known, x.base))] if first else [np.zeros(len(x.length), t) for t in (np.int64, np.int64, float)]
            yield pa.RecordBatch.from_arrays([x.ids, x.prints, *map(pa.array, (*told, np.add.reduceat(logs, x.starts)))], names=["doc_id", "text_hash", *SUMS])

    return rows.mapInArrow(run, PART)


def packed(x: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, compressed: high bytes of sorted or small numbers hardly differ."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def numbered(rows: DataFrame, p: LanguageModel) -> DataFrame:
    """``(portion, part, ids, train, length, words, tokens)``: portions of ``rows(doc_id, text, train)``; ``tokens`` are places in ``words``, the keys of a portion's words."""
    schema = "portion long, part long, ids array<long>, train array<boolean>, length array<int>, n_words int, words binary, tokens binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = Words()
        for k, (held, texts) in enumerate(portions(batches, 1, p.large_portion)):
            words.forget()
            # a hundred texts at a time, as words are objects before they are numbers
            some = [words.tokens(texts[a : a + 100]) for a in range(0, len(texts), 100)]
            tokens, length = (np.concatenate(x).astype("<u4") for x in zip(*some, strict=True))
            one = [(TaskContext.get().partitionId() << 32) + k, -1, *(pa.concat_arrays([b.column(c) for b in held]) for c in (0, 2)), length.tolist(), len(words.keys), packed(words.keys), packed(tokens)]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary())
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) if isinstance(c, pa.Array) else pa.array([c], t) for c, t in zip(one, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(lists, names=names)

    return rows.mapInArrow(run, schema)


@dataclass
class Numbered:
    """A portion of numbered words and its distinct bigrams in order of their keys: ``pairs`` end first in token ``at``, and each token's is ``of``."""

    portion: int
    ids: list
    train: np.ndarray
    length: np.ndarray
    words: Words
    tokens: np.ndarray
    pairs: np.ndarray
    at: np.ndarray
    of: np.ndarray

    @classmethod
    def read(cls, row: dict) -> Numbered:
        words, length = Words(), np.array(row["length"], np.int64)
        words.keys = unpacked(row["words"], row["n_words"], "<u8")
        tokens = unpacked(row["tokens"], int(length.sum()), "<u4").astype(np.int64)
        return cls(row["portion"], row["ids"], np.array(row["train"], bool), length, words, tokens, *np.unique(bigram_keys(words, tokens), return_index=True, return_inverse=True))


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def answered(numbers: DataFrame, tasks: int, ranges: int, bits: int, p: LanguageModel) -> DataFrame:
    """``(portion, part, n_words, n_pairs, levels, counts, grams, total)``: the answer to each portion from each range of the hash; for each range one row
    without a portion, which has its distinct training words and their sum.

    ``levels`` are those of the portion's words of the range by key, then of its bigrams; ``counts`` are the words' exact ones.
    """
    sent = "part long, portion long, n_words int, n_pairs int, keys binary, n binary"
    told = "portion long, part long, n_words int, n_pairs int, levels binary, counts binary, grams long, total long"
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}

    def batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
        cols = [c.split() for c in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(v, kinds[t]) for v, (_, t) in zip(zip(*rows, strict=True), cols, strict=True)], names=[c for c, _ in cols])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1 << ranges, dtype=np.uint64) << np.uint64(64 - ranges) if ranges else np.zeros(1, np.uint64)
        for row in each_row(batches):
            x = Numbered.read(row)
            order = np.argsort(x.words.keys)
            words, training = x.words.keys[order], np.repeat(x.train, x.length)
            n = np.bincount(x.tokens[training], minlength=len(words))[order].astype("<u4")
            m = np.bincount(x.of[training], minlength=len(x.pairs)).astype("<u4")
            cuts = [np.append(np.searchsorted(keys, edges), len(keys)) for keys in (words, x.pairs)]
            out = []
            for part, (a, b, c, d) in enumerate(zip(cuts[0], cuts[0][1:], cuts[1], cuts[1][1:], strict=False)):
                if a < b or c < d:
                    out.append((part, x.portion, b - a, d - c, packed(np.concatenate([words[a:b], x.pairs[c:d]])), packed(np.concatenate([n[a:b], m[c:d]]))))
            yield batch(out, sent)

    def answer(part: int, blocks: list[dict]) -> pa.RecordBatch:
        sizes = [b["n_words"] + b["n_pairs"] for b in blocks]
        keys = np.concatenate([unpacked(b["keys"], z, "<u8") for b, z in zip(blocks, sizes, strict=True)])
        n = np.concatenate([unpacked(b["n"], z, "<u4") for b, z in zip(blocks, sizes, strict=True)])
        order = np.argsort(keys)
        new = np.concatenate([[True], np.diff(keys[order]) != 0])
        of = np.empty(len(keys), np.int64)
        of[order] = np.cumsum(new) - 1
        keys, count = keys[order[new]], np.add.reduceat(n[order].astype(np.int64), np.flatnonzero(new))
        level = np.zeros(len(keys), np.uint8)
        for kind in (WORDS, BIGRAMS):
            own = np.flatnonzero((keys & ONE) == kind)
            seen = own[count[own] > 0]
            bloom = joined(segments(keys[seen], count[seen], bits, p), part << (bits - ranges), 1 << (bits - ranges), bits, p)
            for a in range(0, len(own), 1 << 18):
                some = own[a : a + (1 << 18)]
                level[some] = bloom.levels(keys[some])
        out, at = [], 0
        for b, z in zip(blocks, sizes, strict=True):
            mine = of[at : at + z]
            out.append((b["portion"], part, b["n_words"], b["n_pairs"], packed(level[mine]), packed(count[mine[: b["n_words"]]]), None, None))
            at += z
        words = count[((keys & ONE) == WORDS) & (count > 0)]
        return batch([*out, (None, part, None, None, None, None, len(words), int(words.sum()))], told)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blocks in groupby(each_row(batches), itemgetter("part")):
            yield answer(part, list(blocks))

    return numbers.mapInArrow(send, sent).repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(make, told)


def joined(made: Iterator[tuple[int, int, int, int, bytes]], first: int, n: int, bits: int, p: LanguageModel) -> LogBloom:
    """The ``n`` segments from number ``first`` on."""
    found = {seg: (size, data) for seg, size, _, _, data in made}
    row = [found.get(first + k, (0, b"")) for k in range(n)]
    return LogBloom(np.frombuffer(b"".join(d for _, d in row) or b"\0", np.uint8), np.cumsum([0, *(z for z, _ in row)]), first, bits, p.probes, p.higher_probes)


def scored(numbers: DataFrame, answers: DataFrame, total: float, p: LanguageModel) -> DataFrame:
    """The rows of all portions with their sums; a portion and the answers to it meet in one task, those by range after it."""

    def sums(x: Numbered, parts: list[dict]) -> pa.RecordBatch:
        level, joint, count = [], [], []
        for r in parts:
            both = unpacked(r["levels"], r["n_words"] + r["n_pairs"], "u1")
            level.append(both[: r["n_words"]])
            joint.append(both[r["n_words"] :])
            count.append(unpacked(r["counts"], r["n_words"], "<i8"))
        order, joint = np.argsort(x.words.keys), np.concatenate(joint)
        if sum(map(len, level)) != len(order) or len(joint) != len(x.pairs):
            raise RuntimeError(f"answers to a portion of {len(order)} words and {len(x.pairs)} bigrams are missing")
        words, c = np.zeros(len(order), np.uint8), np.zeros(len(order))
        words[order], c[order] = np.concatenate(level), np.concatenate(count)
        v = before(x.tokens)
        # a bigram has one word and one context
        logs = log_p(expected(joint), words[x.tokens[x.at]], words[v[x.at]], total, p)
        starts = np.cumsum(x.length) - x.length
        told = (np.add.reduceat(y, starts) for y in ((c > 0).astype(np.int64)[x.tokens], np.log10((c + 1) / total)[x.tokens], logs[x.of]))
        return pa.RecordBatch.from_arrays([pa.array(x.ids, pa.int64()), *map(pa.array, (x.length, *told))], names=["doc_id", *SUMS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(each_row(batches), itemgetter("portion")):
            first = next(rows)
            if first["part"] != -1:
                raise RuntimeError("answers without their portion")
            yield sums(Numbered.read(first), list(rows))

    n, least = numbers.count(), int(numbers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = numbers.withColumn("n_pairs", F.lit(None).cast("int")).unionByName(answers.where("portion IS NOT NULL").drop("grams", "total"), allowMissingColumns=True)
    placed = both.repartition(max(1, min(n, max(least, n // 8))), "portion").sortWithinPartitions("portion", "part")
    return placed.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def large_scores(rows: DataFrame, held: Column, size: int, bits: int, p: LanguageModel) -> tuple[DataFrame, int]:
    """Sums per row and N, without any broadcast."""
    numbers = materialize(numbered(rows.select("doc_id", "text", (~held).alias("train")), p), "numbers")
    answers = materialize(answered(numbers, *dealt(rows, size, bits, p), bits, p), "answers")
    v, n = answers.where("portion IS NULL").agg(F.coalesce(F.sum("grams"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    return scored(numbers, answers, float(n + v + 1), p), n


def lm_score(docs: DataFrame, p: LanguageModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    p = p or LanguageModel()
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % p.fold == p.held, F.lit(False))
    training = rows.where(~held)
    size = training.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = max(0, -(-size // p.segment_bytes) - 1).bit_length()
    final = lambda out, n: out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
    if size > p.large_bytes:
        return final(*large_scores(rows, held, size, bits, p))
    since = made()
    built = materialize(build(training, size, bits, p), "filter")
    sums = {r["kind"]: (r["v"], r["n"]) for r in built.groupBy("kind").agg(F.sum("grams").alias("v"), F.sum("total").alias("n")).collect()}
    v, n = sums.get(WORDS, (0, 0))
    word_runs, pair_runs = (shards(built, kind, bits, p.filter_bytes) for kind in (WORDS, BIGRAMS))
    if v > p.broadcast_words or len(pair_runs) > p.passes:
        release(spark, since, 0)
        return final(*large_scores(rows, held, size, bits, p))
    total = float(n + v + 1)
    share = lambda kind, run: spark.sparkContext.broadcast(load(built, kind, *run, bits, p))
    exact = spark.sparkContext.broadcast(exact_counts(built))
    passes = [(i, j) for i in range(len(word_runs)) for j in range(len(word_runs))]
    several = len(passes) * len(pair_runs) > 1
    parts = []
    for i, j in passes:
        words = share(WORDS, word_runs[i]) if j == 0 else words
        contexts = words if i == j else share(WORDS, word_runs[j])
        for k in range(len(pair_runs)):
            pairs = share(BIGRAMS, pair_runs[k])
            part = one_pass(rows, words, contexts, pairs, exact, (i, j, k) == (0, 0, 0), total, p)
            if several:
                # its sums are written before the next shard comes, so one of each is held at a time
                part = materialize(part, "partial")
                pairs.destroy(blocking=True)
            parts.append(part)
        if several:
            for done in {id(x): x for x in ([contexts] if i != j else []) + ([words] if j == len(word_runs) - 1 else [])}.values():
                done.destroy(blocking=True)
    out, by = parts[0], ["doc_id", "text_hash"]
    if len(parts) > 1:
        for other in parts[1:]:
            out = out.unionByName(other)
        # repeated rows add up alike in every pass; only the first tells tokens, of which every row has some
        copies = F.count_if(F.col("n_tokens") > 0)
        out = out.groupBy(*by).agg(copies.cast("int").alias("copies"), *((F.sum(c) / copies).alias(c) for c in SUMS))
        out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*by, *(F.col(c).cast("long").alias(c) for c in SUMS[:2]), *SUMS[2:])
    return final(out, n)
