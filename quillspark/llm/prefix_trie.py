"""Operator 13: the trie of conversations' prefixes, its subtree sums by heavy-path decomposition.

Rebuilding.  A conversation takes its first turns from the first conversation of its block of ``block`` ids (how
many is told by a checksum of its id) and goes on with its own.
Nodes.  A node is a distinct sequence of first turns.  Each turn is hashed with its place, twice 64 bits over a SHA-256 of
its role and text, and a prefix is known by its depth and the exclusive-or of its turns' hashes, so that its parent's key
comes from its own without a join.
Heavy paths.  Each node's largest child (most members, then the smallest conversation) continues its path, the other children
begin paths of their own.  Any way down meets at most log2(members) such beginnings.  Their number above a node is its path's
level; the levels are taken from the deepest up: subtree sums are suffix sums along a path's array, and what a path's
first node sums is added to its parent, which lies on a path of a lesser level.

Running values (turns in order, prefixes, the path a node is on, suffix sums) are all made by ``running``, which cuts each
sequence at range borders, so that neither one conversation nor one path that holds a third of all rows meets in one task.
Nodes' members are counted with partial sums.  The ids of one node's ended conversations are joined to chunks where they were
sorted, and the chunks are digested as they stream, so no task holds them all.

Defined cases: null role and text become empty; rows without a conversation id belong to none and are left out; a null turn
comes first; turns of equal number are ordered by role and digest of the text, repeated rows all count as turns.  A conversation
whose rebuilt form has no turn is a member of the root alone.  Without conversations there is no node, not even the root.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tune

PART, KEY = "__part", ["depth", "a", "b"]
#: Bytes of joined ids in one row.
CHUNK = 1 << 20


@dataclass(frozen=True)
class Rebuild:
    block: int = 20
    #: The first turns taken are the id's checksum modulo this.
    fold: int = 4


def _sum(a: Column, b: Column) -> Column:
    return a + F.coalesce(b, F.lit(0))


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(F.coalesce(b, F.lit(0)))


#: Aggregate, and how a value is put together with that of all before it (null: none).
SUM, XOR, MAX = (F.sum, _sum), (F.bit_xor, _xor), (F.max, F.greatest)


def running(rows: DataFrame, key: list[str], order: list[Column], made: dict[str, tuple[tuple, Column]], name: str) -> DataFrame:
    """``rows`` with running values ``made`` (name -> (SUM, XOR or MAX, column)) of each ``key`` in ``order``.

    Rows are dealt out by ranges of key and order, so a long sequence lies in several parts in turn.  Only a key at a border
    of a part can: of these, at most two a part, the parts' totals are summed up and added to what a part has by itself.
    ``order`` must tell rows of a key apart for a result that doesn't vary.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(rows.repartitionByRange(parts, *key, *order).withColumn(PART, F.spark_partition_id()), name)
    border = [placed.groupBy(PART).agg(f(F.struct(*key)).alias("k")).select(PART, "k.*") for f in (F.min, F.max)]
    totals = placed.join(F.broadcast(border[0].unionByName(border[1]).distinct()), [*key, PART]).groupBy(*key, PART).agg(*(f(c).alias(n) for n, ((f, _), c) in made.items()))
    before = Window.partitionBy(*key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*key, PART, *(f(n).over(before).alias(f"__{n}") for n, ((f, _), _) in made.items()))
    upto = Window.partitionBy(PART, *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = placed.select("*", *(f(c).over(upto).alias(n) for n, ((f, _), c) in made.items()))
    both = own.join(F.broadcast(carried), [*key, PART], "left")
    return both.select(*rows.columns, *(put(F.col(n), F.col(f"__{n}")).alias(n) for n, ((_, put), _) in made.items()))


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, at`` (from 1), ``element`` (digest of role and text) and ``words`` of the text, per turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("said_by"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("element"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        # equal rows are interchangeable, but must lie in more than one range where they are many
        F.monotonically_increasing_id().alias("row"),
    )
    return running(rows, ["conv_id"], [F.col(c) for c in ("turn", "said_by", "element", "row")], {"at": (SUM, F.lit(1).cast("long"))}, "turns").select("conv_id", "at", "element", "words")


def rebuild(rows: DataFrame, p: Rebuild) -> tuple[DataFrame, DataFrame]:
    """Conversations ``(conv_id, length)``, and their rebuilt turns ``(conv_id, depth, element, words)``."""
    base = F.col("conv_id") - F.col("conv_id") % p.block
    first = rows.where((F.col("conv_id") == base) & (F.col("at") < p.fold)).select(F.col("conv_id").alias("base"), "at", "element", "words")
    there = first.groupBy("base").agg(F.count("*").alias("there"))
    own = rows.groupBy("conv_id").agg(F.max("at").alias("own")).withColumn("base", base).withColumn("first", F.crc32(F.col("conv_id").cast("string")) % p.fold)
    taken = F.least("first", F.coalesce("there", F.lit(0)))
    convs = own.join(there, "base", "left").select("conv_id", "base", "first", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("first"), F.lit(0))).alias("length"))
    convs = materialize(convs, "conversations")
    head = convs.where("taken > 0").join(first, "base").where("at <= taken").select("conv_id", F.col("at").alias("depth"), "element", "words")
    tail = rows.join(convs.select("conv_id", "first", "taken"), "conv_id").where("at > first").select("conv_id", (F.col("at") - F.col("first") + F.col("taken")).alias("depth"), "element", "words")
    return convs.select("conv_id", "length"), head.unionByName(tail)


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """``conv_id, depth, a, b`` (the prefix's key with its depth), ``pa, pb`` (its parent's) and ``words``, per rebuilt turn."""
    hashed = rebuilt.select("conv_id", "depth", "words", F.xxhash64(F.lit(1), "depth", "element").alias("own_a"), F.xxhash64(F.lit(2), "element", "depth").alias("own_b"))
    chained = running(hashed, ["conv_id"], [F.col("depth")], {"a": (XOR, F.col("own_a")), "b": (XOR, F.col("own_b"))}, "rebuilt")
    return chained.select("conv_id", *KEY, F.col("a").bitwiseXOR(F.col("own_a")).alias("pa"), F.col("b").bitwiseXOR(F.col("own_b")).alias("pb"), "words")


def tree(chains: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes: their key, their parent's, ``conv_id, n_convs, words, n_children`` and whether a path begins there (``light``)."""
    inner = chains.groupBy(*KEY).agg(*(F.first(c).alias(c) for c in ("pa", "pb", "words")), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(*(zero.alias(c) for c in (*KEY, "pa", "pb", "words")), "conv_id", "n_convs")
    nodes = materialize(inner.unionByName(root), "nodes", small=True)
    largest = F.max(F.struct("n_convs", (-F.col("conv_id")).alias("least"), *KEY)).alias("largest")
    kids = materialize(nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"), largest), "kids", small=True)
    heavy = kids.select(*(F.col(f"largest.{c}").alias(c) for c in KEY), F.lit(False).alias("light"))
    nodes = nodes.join(kids.drop("largest"), KEY, "left").join(heavy, KEY, "left")
    return materialize(nodes.withColumn("n_children", F.coalesce("n_children", zero)).withColumn("light", F.coalesce("light", F.lit(True))), "tree", small=True)


def paths(chains: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` with the key of their path's first node (``head``) and the path's ``level``.

    Both are read off on the way down to a node in its smallest conversation: the last light node, and how many there were.
    """
    way = chains.select("conv_id", *KEY).join(nodes.select("conv_id").distinct(), "conv_id", "left_semi")
    marked = way.join(nodes.select(*KEY, "light", F.col("conv_id").alias("least")), KEY)
    head = F.when(F.col("light"), F.struct(*KEY))
    found = running(marked, ["conv_id"], [F.col("depth")], {"head": (MAX, head), "level": (SUM, F.col("light").cast("long"))}, "ways")
    zero = F.lit(0).cast("long")
    top = F.struct(*(zero.alias(c) for c in KEY))
    told = nodes.join(found.where("conv_id = least").select(*KEY, "head", "level"), KEY, "left")
    return materialize(told.withColumn("head", F.coalesce("head", top)).withColumn("level", F.coalesce("level", zero)), "paths", small=True)


def subtree_sums(nodes: DataFrame, values: dict[str, Column]) -> DataFrame:
    """The nodes' keys with each value summed over their subtrees, level by level from the deepest paths up."""
    top = nodes.agg(F.max("level")).first()[0]
    out, given = None, None
    for level in range(-1 if top is None else top, -1, -1):
        here = nodes.where(F.col("level") == level)
        own = here.select(*KEY, "pa", "pb", "light", *(F.col(f"head.{c}").alias(f"head_{c}") for c in KEY), *(v.alias(f"own_{n}") for n, v in values.items()))
        if given is not None:
            own = own.join(given, KEY, "left").select(*own.columns[:-len(values)], *((F.col(f"own_{n}") + F.coalesce(F.col(n), F.lit(0))).alias(f"own_{n}") for n in values))
        summed = materialize(running(own, [f"head_{c}" for c in KEY], [F.desc("depth")], {n: (SUM, F.col(f"own_{n}")) for n in values}, "arrays"), "sums", small=True)
        given = summed.where("light and depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(*(F.sum(n).alias(n) for n in values))
        # a level's nodes may gain from a deeper path than the next one
        if out is not None:
            given = given.unionByName(waiting).groupBy(*KEY).agg(*(F.sum(n).alias(n) for n in values))
        waiting = given
        told = summed.select(*KEY, *values)
        out = told if out is None else out.unionByName(told)
    return nodes.select(*KEY, *(F.lit(0).cast("long").alias(n) for n in values)) if out is None else out


def ends(convs: DataFrame, chains: DataFrame) -> DataFrame:
    """``ends_sha256`` of the nodes at which conversations end."""
    last = convs.where("length > 0").join(chains, [convs["conv_id"] == chains["conv_id"], convs["length"] == chains["depth"]]).select(*KEY, convs["conv_id"])
    zero = F.lit(0).cast("long")
    rows = last.unionByName(convs.where("length = 0").select(*(zero.alias(c) for c in KEY), "conv_id"))
    n = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((c, pa.int64()) for c in (*KEY, "since")), ("ids", pa.string())])
        now, since, held, size = None, None, [], 0
        for batch in batches:
            out = []
            for *key, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (key != now or size > CHUNK):
                    out.append((*now, since, ",".join(held)))
                    held, size = [], 0
                if not held:
                    now, since = key, conv
                held.append(str(conv))
                size += len(held[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*now, since, ",".join(held)), schema, strict=True)], schema=schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        schema = pa.schema([*((c, pa.int64()) for c in KEY), ("ends_sha256", pa.string())])
        now, state = None, None
        for batch in batches:
            out = []
            for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key == now:
                    state.update(b",")
                else:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*now, state.hexdigest()), schema, strict=True)], schema=schema)

    chunks = rows.repartitionByRange(n, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(chunk, "depth long, a long, b long, since long, ids string")
    return chunks.repartition(n, *KEY).sortWithinPartitions(*KEY, "since").mapInArrow(digest, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, p: Rebuild | None = None) -> DataFrame:
    """Per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    tune(conversations.sparkSession)
    convs, rebuilt = rebuild(materialize(turns(conversations), "turns"), p or Rebuild())
    chains = materialize(prefixes(rebuilt), "chains")
    nodes = paths(chains, tree(chains, convs))
    sums = subtree_sums(nodes, {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")})
    ended = materialize(ends(convs, chains), "ends", small=True)
    told = nodes.join(sums, KEY).join(ended, KEY, "left")
    # the root's children, often most nodes, need no join to tell their parent
    root = nodes.where("depth = 0").select("conv_id").first()
    parent = nodes.select(F.col("depth").alias("up"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    deep = told.where("depth > 1").join(parent, (F.col("depth") - 1 == F.col("up")) & (F.col("pa") == F.col("up_a")) & (F.col("pb") == F.col("up_b"))).drop("up", "up_a", "up_b")
    least = F.lit(root["conv_id"] if root else None).cast("long")
    shallow = told.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, least))
    return deep.unionByName(shallow).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
