"""Operator 2: document quality by hierarchical empirical Bayes.

Evidence of a document: logistic regression over its shape (shares of letters, capitals, digits,
symbols; repeated words and lines; word length; delimiters), fitted on all labelled rows, or on ``train_rows``
of them where a caller asks for that.  Shapes are made once a text and written; up to ``local_rows`` training rows are fitted in
the driver, more by Newton's rounds over sums that tasks make, so neither form leaves a row out.  Evidence of its site: the good and bad counts of the labelled rows of its host and
of its path, each path's rate shrunk towards its host's and each host's towards the global rate,
with prior strengths estimated from the spread of the rates (method of moments).  Both meet as
log-odds: the document's own plus what its path's posterior says beyond the global rate.

Sites are made by grouped aggregation with partial sums, so a host that holds a third of all rows
is one row per task before it moves.  Only counts and posteriors are joined back, never texts: the
table of sites is broadcast while its counted bytes are within ``broadcast_sites``, else joined with
adaptive splitting of skewed hosts.

Defined cases: a null text counts as empty; an empty text's evidence is the model's for zero words.
A null host or path is a site of its own.  The posterior of a labelled document's site has its own label in it, and a row
repeated with one doc_id counts its label as often as it occurs.  Labels other than 0 and 1 are not learned from; without labels of both
kinds a fixed rule (share of letters) holds.  Repeated rows are scored alike.  Empty tables give no
rows.  Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, materialize, text_hash, tune
from .toxicity import logistic, newton, slopes

FEATURES = 12
#: Bytes of the sites' names and posteriors.
BROADCAST_SITES = 16 << 20
#: Training rows of a few numbers that come to the driver; more are fitted by sums.
LOCAL_ROWS = 20_000
RIDGE = 2.0


def shape(text: str) -> list[float]:
    """The document's features; each is a share between 0 and 1 or a bounded logarithm."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, int)
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    high = counts[128:].sum()
    digit, white = counts[48:58].sum(), counts[[9, 10, 11, 12, 13, 32]].sum()
    plain = counts[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum()
    symbol = n - upper - lower - high - digit - white - plain
    words = text.split()
    m = max(1, len(words))
    same = sum(map(str.__eq__, words, words[1:]))
    lines = text.split("\n")
    return [
        (lower + high) / n,
        upper / max(1, upper + lower),
        digit / n,
        symbol / n,
        counts[33] / m,
        counts[124] / m,
        same / m,
        len(set(words)) / m,
        1 - len(set(lines)) / len(lines),
        min(1.0, sum(map(len, words)) / m / 20),
        np.log1p(len(words)) / 10,
        float(not words),
    ]


def _shapes(rows: DataFrame) -> DataFrame:
    """``doc_id, host, path, text_hash`` and the features ``x`` of every row; texts are read here only."""
    told = ["doc_id", "host", "path", "text_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [shape(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in told), pa.array(x, pa.list_(pa.float64()))], names=[*told, "x"])

    return rows.select(*told, "text").mapInArrow(run, "doc_id long, host string, path string, text_hash long, x array<double>")


def _matrix(x: pa.Array | pa.ChunkedArray) -> np.ndarray:
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), FEATURES)


def _features(rows: DataFrame) -> DataFrame:
    """Ids, labels and features of the training rows, written as the rounds of the fit read them again."""
    return materialize(rows.select("doc_id", "y", "x"), "training", small=True)


def _sums(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """``of(x, y)``, a flat array, added up over all batches; one array a task comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                some = of(_matrix(batch.column("x")), batch.column("y").to_numpy().astype(float))
                total = some if total is None else total + some
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    return np.sum(rows.select("y", "x").mapInArrow(run, "sums array<double>").toArrow()["sums"].to_pylist(), axis=0)


#: Used without labels: letters speak for quality, capitals, symbols and repeats against it.
FIXED = (np.array([4.0, -4, -2, -8, -1, -4, -8, 0, -2, 0, 0, -6]), 1.0)


def fit(shapes: DataFrame, labels: DataFrame, train_rows: int | None = None, local_rows: int = LOCAL_ROWS) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Weights, bias, means and scales from all labelled rows, or from the ``train_rows`` of least hash.

    Of documents that repeat an id, one stands for its label: that of the least text hash.
    """
    chosen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    if train_rows is not None:
        chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    chosen = F.broadcast(chosen) if labels.count() <= BROADCAST_IDS else chosen
    rows = shapes.select("doc_id", "text_hash", "x").join(chosen, "doc_id")
    rows = _features(rows.groupBy("doc_id").agg(F.min_by("x", "text_hash").alias("x"), F.max("y").alias("y")))
    count = rows.agg(F.count("*").alias("n"), F.sum("y").alias("good")).first()
    n = count["n"]
    if not n or count["good"] in (0, n):
        return *FIXED, np.zeros(FEATURES), np.ones(FEATURES)
    if n <= local_rows:
        got = rows.toArrow().sort_by("doc_id")
        x, y = _matrix(got["x"]), got["y"].to_numpy().astype(float)
        mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        # features beyond linear: squares let a share that is normal in the middle be bad at both ends
        w, b = logistic(_expand((x - mean) / scale), y, ridge=RIDGE)
        return w, b, mean, scale
    mean = _sums(rows, lambda x, y: x.sum(0)) / n
    scale = np.maximum(np.sqrt(_sums(rows, lambda x, y: ((x - mean) ** 2).sum(0)) / n), 1e-3)

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            gradient, hessian = slopes(np.hstack([_expand((x - mean) / scale), np.ones((len(x), 1))]), y, w)
            return np.append(gradient, hessian)

        both = _sums(rows, of)
        return both[: len(w)], both[len(w) :].reshape(len(w), -1)

    w = newton(sums, np.zeros(2 * FEATURES + 1), np.append(np.full(2 * FEATURES, RIDGE), 1e-6))
    return w[:-1], float(w[-1]), mean, scale


def _expand(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -8, 8)
    return np.hstack([z, z * z / 4])


def _log_odds(x: np.ndarray, model: tuple) -> np.ndarray:
    w, b, mean, scale = model
    z = (x - mean) / scale
    return np.clip((_expand(z) if len(w) == 2 * FEATURES else z) @ w + b, -12, 12)


def moments(rows: DataFrame, good: str, bad: str, centre: str) -> float:
    """Prior strength of rates around their centres: from the spread beyond binomial noise.

    With n_i counts of rate r_i around m_i, the sum of n_i (r_i - m_i)^2 is about
    sum m_i (1 - m_i) (1 + (n_i - 1) / (s + 1)); solved for s and held in [1, 1e4].
    """
    n = F.col(good) + F.col(bad)
    rate = F.col(good) / n
    noise = F.col(centre) * (1 - F.col(centre))
    r = rows.where(n > 0).agg(
        F.sum(n * (rate - F.col(centre)) ** 2).alias("spread"), F.sum(noise).alias("noise"), F.sum(noise * (n - 1)).alias("more")
    ).first()
    excess = (r["spread"] or 0.0) - (r["noise"] or 0.0)
    return float(min(1e4, max(1.0, (r["more"] or 0.0) / excess - 1))) if excess > 0 else 1e4


def sites(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """``(host, path, site)`` with the path's posterior log-odds, and the global log-odds.

    ``docs(doc_id, host, path)``; counts are of labelled documents.
    """
    y = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    # labels are the small side as long as their counted number is
    y = F.broadcast(y) if labels.count() <= BROADCAST_IDS else y
    paths = (
        docs.join(y, "doc_id", "left")
        .groupBy("host", "path")
        .agg(F.coalesce(F.sum("y"), F.lit(0.0)).alias("good"), F.coalesce(F.sum(1 - F.col("y")), F.lit(0.0)).alias("bad"))
    )
    paths = materialize(paths, "paths", small=True)
    total = paths.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    rate = ((total["g"] or 0.0) + 1) / ((total["g"] or 0.0) + (total["b"] or 0.0) + 2)
    hosts = paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("bad").alias("host_bad")).withColumn("centre", F.lit(rate))
    hosts = materialize(hosts, "hosts", small=True)
    s = moments(hosts, "host_good", "host_bad", "centre")
    hosts = hosts.withColumn("host_rate", (F.col("host_good") + s * rate) / (F.col("host_good") + F.col("host_bad") + s)).select(
        F.col("host").alias("of_host"), "host_rate"
    )
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host")
    t = moments(both, "good", "bad", "host_rate")
    path_rate = (F.col("good") + t * F.col("host_rate")) / (F.col("good") + F.col("bad") + t)
    site = F.log(path_rate / (1 - path_rate))
    return materialize(both.select("host", "path", site.alias("site")), "sites", small=True), float(np.log(rate / (1 - rate)))


def quality(
    docs: DataFrame,
    labels: DataFrame,
    host_col: str = "source",
    path_cols: tuple[str, ...] = ("source", "lang"),
    train_rows: int | None = None,
    threshold: float = 0.5,
    site_weight: float = 0.5,
    broadcast_sites: int = BROADCAST_SITES,
    local_rows: int = LOCAL_ROWS,
) -> DataFrame:
    """Per input row: ``doc_id, host, path, doc_log_odds, site_log_odds, score, kept, text_hash``."""
    spark = docs.sparkSession
    tune(spark)
    path = F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in path_cols))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), text_hash().alias("text_hash"), F.col(host_col).cast("string").alias("host"), path.alias("path"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    shapes = materialize(_shapes(rows), "shapes")
    model = fit(shapes, labels, train_rows, local_rows)
    table, base = sites(shapes.select("doc_id", "host", "path"), labels)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array(_log_odds(_matrix(batch.column("x")), shared.value))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in told), own], names=[*told, "doc_log_odds"])

    told = ["doc_id", "host", "path", "text_hash"]
    scored = shapes.select(*told, "x").mapInArrow(run, "doc_id long, host string, path string, text_hash long, doc_log_odds double")
    right = table.select(F.col("host").alias("h"), F.col("path").alias("p"), "site")
    size = right.agg(F.sum(F.coalesce(F.octet_length("h"), F.lit(0)) + F.octet_length("p") + 24)).first()[0] or 0
    right = F.broadcast(right) if size <= broadcast_sites else right
    joined = scored.join(right, F.col("host").eqNullSafe(F.col("h")) & (F.col("path") == F.col("p")), "left")
    lift = F.coalesce(F.col("site"), F.lit(base)) - F.lit(base)
    score = 1 / (1 + F.exp(-(F.col("doc_log_odds") + site_weight * lift)))
    return joined.select("doc_id", "host", "path", "doc_log_odds", lift.alias("site_log_odds"), score.alias("score"), (score >= threshold).alias("kept"), "text_hash")
