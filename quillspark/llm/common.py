"""What the training-data operators share: shared storage, bounded broadcasts, components.

Nothing here collects an unbounded table to the driver.  Cut points are Parquet tables in the
folder that the cluster names in ``spark.checkpoint.dir``, so a lost executor loses no result.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text that go to a Python worker at once; long texts make a batch of few rows large.
ARROW_ROWS = 256
ARROW_BYTES = 8 << 20
#: An id set of at most this many rows is broadcast (8 bytes each, about 30 MB as a relation).
BROADCAST_IDS = 500_000


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches, in rows and in bytes, so that long texts don't fill a worker.

    Set for the session, as the plans that are returned run later.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset and all is one process (tests), an own one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # the session may already be gone at exit
        pass


#: Folders of tables that are still there, oldest first.
_made: list[str] = []


def made() -> int:
    """A mark for ``release``."""
    return len(_made)


def release(spark: SparkSession, since: int, last: int = 1) -> None:
    """Remove the tables written since a mark but the ``last`` ones, where no plan reads them any more."""
    gone = _made[since : max(since, len(_made) - last)]
    del _made[since : since + len(gone)]
    for path in gone:
        _remove(spark, path)


@atexit.register
def _remove_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        release(spark, 0, 0)


def materialize(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again; removed by ``release`` or when the driver ends.

    ``small``: rows of a few numbers behind a shuffle, whose tasks take up to eight of its partitions each and write
    one file for them, as each file costs the file system several calls.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quill-{name}-{uuid.uuid4().hex}"
    if small:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def text_hash(column: str = "text"):
    """By this and its id a row is told where ids are null or repeated; null counts as empty."""
    return F.xxhash64(text_of(column))


def keep_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi", limit: int = BROADCAST_IDS, by: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is (``left_semi``) or isn't (``left_anti``) in ``ids``.

    ``ids`` has one column and is materialised.  It is broadcast only when its counted size is
    within ``limit``; beyond it the join shuffles and adaptive execution splits skewed keys.
    """
    right = ids.select(F.col(ids.columns[0]).alias("__keep_id"))
    right = F.broadcast(right) if right.count() <= limit else right
    return docs.join(right, docs[by] == right["__keep_id"], how)


class WordHash(dict):
    """bytes -> 64-bit hash, computed once per distinct word; emptied when it grows too large."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        get = self.__getitem__
        return np.fromiter(map(get, words), dtype=np.uint64, count=len(words))


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit (finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all windows of ``n`` words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:m].copy()
        for k in range(1, n):
            out *= MULTIPLIER
            out += hashes[k : k + m]
    return mix64(out)


def shingle_set(words: list[bytes], table: WordHash, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; a shorter text counts as one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    hashes = table.of(words)
    return np.unique(rolling(hashes, n if len(words) >= n else len(words)) + np.uint64(min(len(words), n)))


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased; words are runs of anything but the six ASCII white-space characters.

    ``bytes.lower`` and ``bytes.split`` do exactly this: both know ASCII only.  Characters that
    UTF-8 can't hold (lone surrogates) are kept by surrogatepass.
    """
    return text.encode("utf-8", "surrogatepass").lower().split()


def batch_words(texts: list[str | None], table: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a batch laid end to end, and where each text begins and the last one ends."""
    flat: list[bytes] = []
    starts = [0]
    for text in texts:
        flat += words_of(text or "")
        starts.append(len(flat))
    return table.of(flat), np.array(starts, np.int64)


def batch_grams(words: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``rolling`` over a batch, and the windows that lie within one text."""
    grams = rolling(words, n)
    ok = np.ones(len(words), bool)
    for k in range(1, n):
        cut = starts[1:] - k
        ok[cut[cut >= 0]] = False
    return grams, np.flatnonzero(ok[: len(grams)])


class Among:
    """Membership in a sorted set of 64-bit values; a bitmap answers most misses."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.some = np.zeros(1 << 20, bool)
        self.some[(values >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Positions in ``x`` of the members."""
        at = np.flatnonzero(self.some[(x >> np.uint64(44)).astype(np.int64)])
        if not len(at) or not len(self.values):
            return at[:0]
        near = np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)
        return at[self.values[near] == x[at]]


def as_i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(src, dst)`` as ``(id, component)``.

    Rounds of large-star and small-star (Kiveris et al., 2014): every node hands its neighbours
    to the least of them, so a hub's neighbours are combined by partial aggregation and no list
    of neighbours is ever held.  ``component`` is the least id reachable.  Each round is written
    to the shared folder; it ends when a round changes no edge.
    """
    e = materialize(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges", small=True
    )
    before, since = None, made() - 1
    for _ in range(max_rounds):
        # large-star: each neighbour larger than u links to the least of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small-star: each node and its smaller neighbours link to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e2 = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = materialize(e2.where("u <> v").distinct(), "edges", small=True)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(edges.sparkSession, since)
        if before is not None and tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
