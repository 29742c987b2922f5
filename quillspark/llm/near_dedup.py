"""Operator 5: near duplicates by banded MinHash, odd sketches and exact confirmation.

1. One pass over the texts makes, per document, the size and a 128-bit fingerprint of its shingle
   set, MinHash samples, ``bands`` bucket keys of ``rows`` samples each, and an odd sketch: every
   sample flips one bit of a bitmap, so shared samples cancel under XOR and the population count
   of two sketches' XOR estimates a high similarity precisely (Mitzenmacher, Pagh and Pham, 2014).
2. Documents with equal sets collapse to their least id by partial aggregation.
3. Buckets link members to two hubs (stars): a pseudo-random member and the one that meets most
   others over all buckets, so a bucket of any size gives at most two pairs a member.  Pairs pass an exact size filter and the sketch's estimate and are then confirmed on
   full shingle sets.
4. Pairs that a star can't decide are those of different components in one bucket.  Of these, each has a member
   outside the bucket's largest component, one of its "loose" documents.  Buckets that still hold several components
   are cut into cells by the logarithm of the set's size, as only neighbouring cells hold pairs within the size
   bound, and the cells and the loose documents into blocks of bounded size: each block of a cell meets each block of the loose
   documents of its own and the two next cells.  So a member is copied once for ``block`` loose documents, not once
   for ``block`` members, and a bucket that the stars have joined but for a few is not copied at all.
   Blocks compare sketches; members of pairs over the estimate's margin get their full sets, and the pairs are
   confirmed in the block, best first, until their components are one.  Only links leave a block,
   fewer than it has members.  Nothing is capped: what a star leaves open, the blocks settle.
5. Components of the confirmed links, by large-star and small-star.

Chance of losing a link at the threshold: all bands miss with (1 - 0.85^5)^32 = 7e-9, the sketch
errs by its margin (0.13, six standard deviations) with about 3e-9; higher similarities less.

Defined cases: a text without words (or null) has an empty set and is its own component; with
fewer words than a shingle the whole sequence is one shingle.  Rows repeated with one doc_id are
one document that occurs repeatedly.  A null doc_id is linked by its set only and never chosen
while another id is there.  An empty table gives no rows.  Columns other than the id and the text
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, components, keep_ids, materialize, mix64, shingle_set, text_hash, tune, words_of


@dataclass(frozen=True)
class NearDup:
    """Parameters; ``percent`` is the least Jaccard similarity of a link in hundredths."""

    words: int = 5
    percent: int = 85
    bands: int = 32
    rows: int = 5
    samples: int = 256
    bits: int = 1024
    margin: float = 0.13
    block: int = 64
    block_shingles: int = 250_000
    seed: int = 20240917

    def permutations(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        a = rng.integers(0, 2**32, self.samples, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        return a, rng.integers(0, 2**32, self.samples, dtype=np.uint64).astype(np.uint32)


#: Shingles that are permuted at once: three arrays of this size stay in a core's cache.
PORTION = 40_000


def minhash(sets: list[np.ndarray], p: NearDup) -> np.ndarray:
    """Samples (documents x samples) of non-empty shingle sets."""
    a, b = p.permutations()
    out = np.empty((len(sets), p.samples), np.uint32)
    k = 0
    while k < len(sets):
        n, end = 0, k
        while end < len(sets) and (end == k or n + len(sets[end]) <= PORTION):
            n += len(sets[end])
            end += 1
        x = (np.concatenate(sets[k:end]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[k : end - 1])])
        y = np.empty_like(x)
        for i in range(p.samples):
            np.multiply(x, a[i], out=y)
            np.add(y, b[i], out=y)
            out[k:end, i] = np.minimum.reduceat(y, starts)
        k = end
    return out


def odd_sketches(samples: np.ndarray, p: NearDup) -> np.ndarray:
    """Parity bitmaps (documents x bits / 8): each sample flips the bit that it hashes to."""
    n = len(samples)
    place = mix64(samples.astype(np.uint64) * np.uint64(p.samples) + np.arange(p.samples, dtype=np.uint64)) % np.uint64(p.bits)
    flat = np.arange(n, dtype=np.int64)[:, None] * p.bits + place.astype(np.int64)
    odd = np.bincount(flat.ravel(), minlength=n * p.bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, p.bits), axis=1)


def estimate(differing: np.ndarray, p: NearDup) -> np.ndarray:
    """Similarity from the population count of two sketches' XOR."""
    rest = np.maximum(1 - 2 * differing / p.bits, 1e-9)
    return 1 + p.bits / (4 * p.samples) * np.log(rest)


def band_keys(samples: np.ndarray, p: NearDup) -> np.ndarray:
    """One 64-bit bucket key per band; the band's number is part of it."""
    keys = np.empty((len(samples), p.bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(p.bands):
            h = np.full(len(samples), b + 1, np.uint64)
            for r in range(p.rows):
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + samples[:, b * p.rows + r].astype(np.uint64))
            keys[:, b] = h
    return keys


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_hash(text_col).alias("text_hash"))


def sketch_documents(docs: DataFrame, p: NearDup) -> DataFrame:
    """``doc_id, text_hash, n_shingles, f1, f2, bands, sketch``; the last four are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        table = WordHash()
        for batch in batches:
            sets = [shingle_set(words_of(t or ""), table, p.words) for t in batch.column(1).to_pylist()]
            some = [i for i, s in enumerate(sets) if len(s)]
            full = [sets[i] for i in some]
            prints = {i: xxhash.xxh3_128_digest(s.tobytes()) for i, s in zip(some, full, strict=True)}
            pairs = {i: np.frombuffer(v, "<i8").tolist() for i, v in prints.items()}
            samples = minhash(full, p) if full else np.empty((0, p.samples), np.uint32)
            bands = dict(zip(some, band_keys(samples, p).view(np.int64).tolist(), strict=True))
            sketch = dict(zip(some, map(bytes, odd_sketches(samples, p)), strict=True)) if full else {}
            each = range(len(sets))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(map(len, sets), pa.int64()),
                    pa.array((pairs[i][0] if i in pairs else None for i in each), pa.int64()),
                    pa.array((pairs[i][1] if i in pairs else None for i in each), pa.int64()),
                    pa.array((bands.get(i) for i in each), pa.list_(pa.int64())),
                    pa.array((sketch.get(i) for i in each), pa.binary()),
                ],
                names=["doc_id", "text_hash", "n_shingles", "f1", "f2", "bands", "sketch"],
            )

    return docs.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, f1 long, f2 long, bands array<long>, sketch binary")


def shingle_sets(docs: DataFrame, p: NearDup) -> DataFrame:
    """``doc_id, shingles``: the sorted 64-bit hashes of the full set, little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHash()
        for batch in batches:
            sets = [shingle_set(words_of(t or ""), table, p.words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles binary")


def _likely(pairs: DataFrame, traits: DataFrame, p: NearDup) -> DataFrame:
    """Pairs within the exact size bound and over the sketch's estimate less its margin."""
    a = traits.select(F.col("doc_id").alias("src"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("s_a"))
    b = traits.select(F.col("doc_id").alias("dst"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("s_b"))
    near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * p.percent
    wide = pairs.join(a, "src").join(b, "dst").where(near).select("src", "dst", "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in (2, 3))
                ok = estimate(np.bitwise_count(x ^ y).sum(1), p) >= p.percent / 100 - p.margin
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], names=["src", "dst"])

    return wide.mapInArrow(run, "src long, dst long")


def confirm(pairs: DataFrame, sets: DataFrame, p: NearDup) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    a = sets.select(F.col("doc_id").alias("src"), F.col("shingles").alias("x"))
    b = sets.select(F.col("doc_id").alias("dst"), F.col("shingles").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = lambda x: np.frombuffer(x.as_buffer(), "<u8")
            ok = [similar(read(x), read(y), p.percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["src", "dst"])

    return pairs.join(a, "src").join(b, "dst").select("src", "dst", "x", "y").mapInArrow(run, "src long, dst long")


def _blocks(members: DataFrame, p: NearDup) -> DataFrame:
    """``(cell keys, band, doc_id, part, n_shingles, role)`` of the buckets that hold several components.

    A group ``key, level, block, chunk`` has a block of a cell's members (role 0) and a chunk of the loose documents
    (role 1) that may be within the size bound of them; either is about ``block`` documents or ``block_shingles`` shingles,
    whichever is less, so a group's sets fit a worker.
    """
    sums = members.groupBy("key", "part").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("mass"))
    most = F.max(F.struct("n", "part", "mass")).alias("most")
    mixed = sums.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("mass").alias("mass"), most).where("parts > 1")
    pieces = lambda n, mass: F.greatest(F.ceil(n / p.block), F.ceil(mass / p.block_shingles)).cast("int")
    mixed = mixed.select("key", F.col("most.part").alias("largest"), pieces(F.col("n") - F.col("most.n"), F.col("mass") - F.col("most.mass")).alias("chunks"))
    # a little over the bound, so that rounding can't part two sizes by more than one level
    base = 100 / p.percent * (1 + 1e-9) if p.percent < 100 else 1 + 1e-6
    own = members.join(mixed, "key").withColumn("level", F.floor(F.log("n_shingles") / float(np.log(base))).cast("int"))
    cells = own.groupBy("key", "level").agg(pieces(F.count("*"), F.sum("n_shingles")).alias("blocks"))
    part_of = lambda n, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), n).cast("int")
    names = ["key", "level", "block", "chunk", "band", "doc_id", "part", "n_shingles", "role"]
    held = own.join(cells, ["key", "level"]).withColumn("block", part_of(F.col("blocks"), 0)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    loose = own.where("part <> largest").withColumn("level", F.explode(F.sequence(F.col("level") - 1, F.col("level") + 1))).join(cells, ["key", "level"])
    loose = loose.withColumn("chunk", part_of(F.col("chunks"), 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # a loose document meets a loose member once: the one of the smaller id is the one that comes to the other's block
    role = F.when(F.col("part") == F.col("largest"), 0).otherwise(2)
    return held.withColumn("role", role).select(names).unionByName(loose.withColumn("role", F.lit(1)).select(names))


CELL = ["key", "level", "block", "chunk"]
GROUP = "key long, level int, block int, chunk int, band int, doc_id long, part long, n_shingles long, role int, bands array<long>, sketch binary"
NAMES = [c.split()[0] for c in GROUP.split(", ")]


def _open(group: pa.Table, p: NearDup) -> Iterator[tuple[int, np.ndarray]]:
    """Of a group, ``(i, js)``: pairs of different components that the sketches can't rule out.

    ``i`` is a loose document, ``js`` are members (role 0 those of the bucket's largest component, 2 loose ones).  A pair
    counts only in the first band in which its two documents meet.
    """
    n = group.num_rows
    ids, part, sizes, role = (group[c].to_numpy() for c in ("doc_id", "part", "n_shingles", "role"))
    band = group["band"][0].as_py()
    member = np.flatnonzero(role != 1)
    if not len(member):
        return
    sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint64).reshape(n, -1)
    keys = group["bands"].combine_chunks().flatten().to_numpy().reshape(n, -1)[:, :band]
    for i in np.flatnonzero(role == 1):
        ok = (part[member] != part[i]) & (np.minimum(sizes[member], sizes[i]) * 100 >= np.maximum(sizes[member], sizes[i]) * p.percent)
        ok &= (role[member] == 0) | (ids[member] > ids[i])
        j = member[ok]
        if len(j):
            near = estimate(np.bitwise_count(sketch[j] ^ sketch[i]).sum(1), p)
            j = j[np.argsort(-near, kind="stable")][: int((near >= p.percent / 100 - p.margin).sum())]
        if band and len(j):
            j = j[~(keys[j] == keys[i]).any(1)]
        if len(j):
            yield i, j


def _open_members(groups: DataFrame, p: NearDup) -> DataFrame:
    """The rows of ``groups`` that are in some open pair."""

    def run(group: pa.Table) -> pa.Table:
        held = np.zeros(group.num_rows, bool)
        for i, j in _open(group, p):
            held[i] = True
            held[j] = True
        return group.select(NAMES).filter(pa.array(held))

    return groups.select(NAMES).groupBy(CELL).applyInArrow(run, GROUP)


def _settle(groups: DataFrame, sets: DataFrame, p: NearDup) -> DataFrame:
    """Links ``(src, dst)`` that join components of a group, confirmed on full shingle sets.

    Pairs come in falling order of the estimate and are skipped once their components are one,
    so a group gives fewer links than it has members.
    """

    def run(group: pa.Table) -> pa.Table:
        ids, part = group["doc_id"].to_numpy(), group["part"].to_pylist()
        full = [np.frombuffer(x.as_buffer(), "<u8") for x in group["shingles"]]
        root = {c: c for c in part}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        src, dst = [], []
        for i, js in _open(group, p):
            for j in js:
                a, b = find(part[i]), find(part[j])
                if a != b and similar(full[i], full[j], p.percent):
                    root[max(a, b)] = min(a, b)
                    src.append(int(ids[i]))
                    dst.append(int(ids[j]))
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return groups.join(sets, "doc_id").select(*NAMES, "shingles").groupBy(CELL).applyInArrow(run, "src long, dst long")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 times the intersection is at least ``percent`` times the union."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def near_dedup(docs: DataFrame, p: NearDup | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: ``doc_id, n_shingles, component_id, kept, text_hash``."""
    p = p or NearDup()
    tune(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    sketches = materialize(sketch_documents(texts, p), "sketches")
    filled = sketches.where("n_shingles > 0")
    groups = materialize(filled.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "groups", small=True)
    copies = groups.where("copies > 1").select("f1", "f2", "n_shingles", "rep")
    # a document stands for its set unless its set has copies and another is the least of them
    marked = filled.join(copies, ["f1", "f2", "n_shingles"], "left").where("rep is null or rep = doc_id").where("doc_id is not null")
    traits = materialize(marked.select("doc_id", "n_shingles", "bands", "sketch"), "traits")
    keyed = traits.select("doc_id", "n_shingles", F.posexplode("bands").alias("band", "key"))
    # the hub is a pseudo-random member, another one in each bucket
    hubs = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("doc_id", "key").alias("at"), F.col("doc_id").alias("hub"))).alias("first"))
    hubs = materialize(hubs.where("size > 1").select("key", "size", F.col("first.hub").alias("hub")), "hubs", small=True)
    members = materialize(keyed.join(hubs, "key"), "members", small=True)
    slim = materialize(traits.join(members.select("doc_id").distinct(), "doc_id", "left_semi"), "slim")
    sets = materialize(shingle_sets(keep_ids(texts.drop("text_hash"), slim.select("doc_id").distinct()), p), "sets")
    # a document that meets many others is near the centre of its family and links most of it
    meets = members.groupBy("doc_id").agg(F.sum("size").alias("meets"))
    centres = members.join(meets, "doc_id").groupBy("key").agg(F.max(F.struct("meets", F.xxhash64("doc_id"), "doc_id"))["doc_id"].alias("centre"))
    stars = members.join(centres, "key").select("doc_id", F.explode(F.array("hub", "centre")).alias("hub")).where(F.col("doc_id") != F.col("hub"))
    stars = stars.select(F.least("doc_id", "hub").alias("src"), F.greatest("doc_id", "hub").alias("dst"))
    parts = components(confirm(_likely(stars.distinct(), slim, p), sets, p))
    now = members.join(parts.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id"))
    now = materialize(now.select("key", "band", "doc_id", "n_shingles", "part"), "parts")
    groups = materialize(_open_members(_blocks(now, p).join(slim.select("doc_id", "bands", "sketch"), "doc_id"), p), "open")
    more = _settle(groups, sets, p)
    # what the stars joined is given by one edge to its least member
    known = parts.select(F.col("id").alias("src"), F.col("component").alias("dst"))
    final = components(known.unionByName(more.select("src", "dst")))
    rep = F.coalesce("rep", "doc_id")
    rows = sketches.select("doc_id", "text_hash", "n_shingles", "f1", "f2").join(copies, ["f1", "f2", "n_shingles"], "left").withColumn("rep", rep)
    rows = rows.join(final.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash")
