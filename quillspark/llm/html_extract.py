"""Operator 11: the main text of web pages by a linear-chain conditional random field over leaf blocks.

Blocks (``html_blocks``).  A page is cut into runs of text between borders of block elements.  Content that no reader sees (scripts,
styles, head, hidden form text) and markup are gone by then, and character references are decoded.
Field.  Each block is ``main`` or ``rest``.  Its features are the elements above it and the words of their class, id and role, those of the nearest
that has such words or a telling name once more, its own element, and its text: length, share in links, punctuation, digits, signs of menus and footers, and its place in the
page; the chain adds a weight for each pair of neighbours.  The weights maximise the likelihood of labelled pages (``labelled_pages``, ``pages``
of them, made from hand-labelled layouts by a seeded draw) less a penalty on their squares; likelihood and gradient come
from forward and backward sums over all pages at once.  They are fitted on the driver in bounded time and memory, whatever the input.
Decoding.  Viterbi, so a block is judged with its neighbours.

White space (as Python's ``str.split`` knows it, so that no-break spaces count) inside a block becomes one space, blocks are joined by
one space in page order, and no text of a main block is dropped.

Defined cases: a null or empty page has the empty text, as has a page without main blocks.  Repeated rows and ids are pages of
their own.  Null ids and addresses are handed on.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune
from .html_blocks import Block, leaf_blocks
from .labelled_pages import labelled_pages


@dataclass(frozen=True)
class Extraction:
    pages: int = 800
    seed: int = 11
    penalty: float = 0.02
    rounds: int = 250


def bucket(n: int) -> int:
    return n.bit_length()


def features(blocks: list[Block]) -> list[list[str]]:
    """The features of each block of a page, without those of the elements above."""
    out = []
    last = max(1, len(blocks) - 1)
    for k, b in enumerate(blocks):
        text = b.text
        n = len(text)
        place = k / last
        own = [
            f"tag:{b.tag}",
            f"long:{bucket(n)}",
            f"linked:{int(b.linked * 4)}",
            "end:sentence" if text[-1] in ".!?…。”\"" else "end:open",
            f"commas:{min(3, text.count(',') + text.count(';'))}",
            "place:first" if k == 0 else "place:last" if k == last else f"place:{int(place * 5)}",
        ]
        if "©" in text:
            own.append("has:copyright")
        if "|" in text or "»" in text or "·" in text:
            own.append("has:separator")
        digits = sum(map(str.isdigit, text[:200]))
        if digits:
            own.append(f"digits:{int(5 * digits / min(n, 200))}")
        if k and blocks[k - 1].above == b.above:
            own.append("same:before")
        if k < len(blocks) - 1 and blocks[k + 1].above == b.above:
            own.append("same:after")
        if k and blocks[k - 1].tag in ("h1", "h2", "h3"):
            own.append("after:heading")
        out.append(own)
    return out


@dataclass
class Field:
    """Weights of features for ``main`` (those for ``rest`` are their negatives), and of neighbours ``[before][now]``."""

    weights: dict[str, float]
    steps: np.ndarray

    def scores(self, blocks: list[Block]) -> np.ndarray:
        get, seen = self.weights.get, {}
        out = np.empty(len(blocks))
        for k, (b, own) in enumerate(zip(blocks, features(blocks), strict=True)):
            above = b.above, b.near
            if above not in seen:
                seen[above] = sum(get(f, 0.0) for fs in above for f in fs)
            out[k] = seen[above] + sum(get(f, 0.0) for f in own)
        return out

    def main(self, blocks: list[Block]) -> list[bool]:
        """The most likely labels (Viterbi)."""
        if not blocks:
            return []
        (rr, rm), (mr, mm) = self.steps.tolist()
        back, rest, main = [], 0.0, 0.0
        for k, s in enumerate(self.scores(blocks).tolist()):
            if k:
                back.append((mr + main > rr + rest, mm + main >= rm + rest))
                rest, main = max(rr + rest, mr + main), max(rm + rest, mm + main)
            rest, main = rest - s, main + s
        out = [main >= rest]
        for from_main in reversed(back):
            out.append(from_main[out[-1]])
        return out[::-1]


def likelihood(x: tuple[np.ndarray, ...], theta: np.ndarray, n_features: int) -> tuple[float, np.ndarray]:
    """Log likelihood of the labelled pages and its gradient; ``theta`` has the features' weights and the four of neighbours.

    ``x``: feature numbers, the block of each, the blocks' places in a grid of pages by blocks, their labels there, and which cells hold a block.
    """
    feature, block, cell, label, there = x
    w, steps = theta[:n_features], theta[n_features:].reshape(2, 2)
    score = np.zeros(there.shape)
    score.flat[cell] = np.bincount(block, w[feature], minlength=len(cell))
    emit = np.stack([-score, score], axis=2)
    pages, length = there.shape
    alpha, beta = np.zeros((pages, length, 2)), np.zeros((pages, length, 2))
    alpha[:, 0] = emit[:, 0]
    for t in range(1, length):
        step = np.logaddexp(alpha[:, t - 1, 0, None] + steps[0], alpha[:, t - 1, 1, None] + steps[1]) + emit[:, t]
        alpha[:, t] = np.where(there[:, t, None], step, alpha[:, t - 1])
    for t in range(length - 2, -1, -1):
        ahead = emit[:, t + 1] + beta[:, t + 1]
        step = np.logaddexp(steps[:, 0] + ahead[:, 0, None], steps[:, 1] + ahead[:, 1, None])
        beta[:, t] = np.where(there[:, t + 1, None], step, 0.0)
    total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    share = np.exp(alpha + beta - total[:, None, None])
    true = np.stack([label == 0, label == 1], axis=2)
    both = there[:, 1:] & there[:, :-1]
    pair_share, pair_true = np.zeros((2, 2)), np.zeros((2, 2))
    for i in range(2):
        for j in range(2):
            p = np.exp(alpha[:, :-1, i] + steps[i, j] + emit[:, 1:, j] + beta[:, 1:, j] - total[:, None])
            pair_share[i, j] = p[both].sum()
            pair_true[i, j] = (true[:, :-1, i] & true[:, 1:, j] & both).sum()
    value = (emit * true)[there].sum() + (pair_true * steps).sum() - total.sum()
    slack = (true[..., 1].astype(float) - true[..., 0]) - (share[..., 1] - share[..., 0])
    gradient = np.bincount(feature, slack.flat[cell][block], minlength=n_features)
    return float(value), np.concatenate([gradient, (pair_true - pair_share).ravel()])


@lru_cache(maxsize=4)
def train(p: Extraction) -> Field:
    pages = [leaf_blocks(page) for page in labelled_pages(p.pages, p.seed)]
    pages = [blocks for blocks in pages if blocks]
    told = [[[*b.above, *b.near, *own] for b, own in zip(blocks, features(blocks), strict=True)] for blocks in pages]
    names = {f: k for k, f in enumerate(sorted({f for page in told for block in page for f in block}))}
    length = max(map(len, pages))
    there, label = np.zeros((len(pages), length), bool), np.zeros((len(pages), length), np.int64)
    feature, block, cell = [], [], []
    for i, (blocks, page) in enumerate(zip(pages, told, strict=True)):
        for t, (b, fs) in enumerate(zip(blocks, page, strict=True)):
            there[i, t], label[i, t] = True, b.label == "main"
            feature += [names[f] for f in fs]
            block += [len(cell)] * len(fs)
            cell.append(i * length + t)
    x = (np.array(feature), np.array(block), np.array(cell), label, there)
    theta = np.zeros(len(names) + 4)
    step, before = np.full(len(theta), 0.05), np.zeros(len(theta))
    for _ in range(p.rounds):  # resilient propagation: a step per weight, longer while its slope keeps its sign
        _, gradient = likelihood(x, theta, len(names))
        gradient -= p.penalty * len(pages) * theta / 10
        agree = np.sign(gradient * before)
        step = np.clip(step * np.where(agree > 0, 1.2, np.where(agree < 0, 0.5, 1.0)), 1e-6, 0.5)
        gradient[agree < 0] = 0
        theta += np.sign(gradient) * step
        before = gradient
    return Field({f: float(theta[k]) for f, k in names.items()}, theta[len(names) :].reshape(2, 2))


def main_text(page: str | None, field: Field) -> str:
    blocks = leaf_blocks(page or "", field.weights)
    return " ".join(b.text for b, main in zip(blocks, field.main(blocks), strict=True) if main)


def extract(pages: DataFrame, p: Extraction | None = None, html_col: str = "html") -> DataFrame:
    """Per page: ``page_id, url, text, n_chars``."""
    spark = pages.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(train(p or Extraction()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            texts = [main_text(page, field) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col(html_col).cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
