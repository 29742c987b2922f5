import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillspark.llm.ranked_search import Search, best, blocks, build_index, impact, ranked_search, search, terms_of, unpack_bits

from .conftest import ODD

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id string, score string, rank string, number string, term string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, top=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, total = len(bags), sum(x for _, _, x in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        asked, scores = Counter(terms(text)), []
        for doc, bag, size in bags:
            m = 25 + (75 * size * n) // total
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t, r in asked.items() if bag[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(scores, key=lambda x: x[:3])[:top])]
    return sorted(out, key=str)


def check(spark, make, docs, items, **p):
    df = spark.createDataFrame([(i, t, *["x"] * 5) for i, t in items], ITEMS)
    out = ranked_search(make([t for _, t in docs], [i for i, _ in docs]), df, Search(**p))
    assert out.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, out.collect()), key=str) == brute(docs, items, p.get("top", 10))


@pytest.mark.parametrize("p", [{}, {"block": 4, "shard_postings": 300}, {"block": 2, "block_terms": 20, "top": 3}])
def test_equal_to_brute_force(spark, make, p):
    draw = random.Random(3)
    words = [f"W{k}" for k in range(60)] + ["the", "É", "x_y-z", "日本"]
    weight = [1 / (k + 1) for k in range(60)] + [3, 1, 1, 1]
    docs = [(k * 7 % 400 - 50, " ".join(draw.choices(words, weight, k=draw.choice([1, 3, 20, 90])))) for k in range(400)]
    docs += [(1000 + k, "the copy of w3 w5 w5") for k in range(150)] + [(None, "w3 w59"), (None, "w3 w59")]
    items = [(k, " ".join(draw.choices(words, k=draw.choice([1, 5, 30])))) for k in range(25)] + [(3, "w5 w5 the copy"), (None, "w59")]
    check(spark, make, docs, items, **p)


def test_odd_rows(spark, make):
    docs = list(zip([5, 4, 4, None, 3, 2, 1, 0, 9, 8], ODD, strict=True)) + [(77, "--"), (78, "a" * 100_000)]
    items = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "A B C D"), (5, "nowhere"), (6, "É x é"), (7, "a" * 100_000)]
    check(spark, make, docs, items)


def test_empty(spark, make):
    none = spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b", *["x"] * 5)], ITEMS)
    assert ranked_search(make(["a"]), none).collect() == []
    assert ranked_search(make([]), some).collect() == []
    assert ranked_search(make([None, "- -"]), some).collect() == []


def test_terms_of_long_texts_are_whole():
    text = "Ab,c" * 2_000_000
    assert sum(map(len, terms_of(text))) == len(TERM.findall(text))


def test_blocks_round_trip():
    draw = np.random.default_rng(1)
    sizes = [1, 127, 128, 129, 700]
    term = np.repeat(np.arange(len(sizes)), sizes)
    doc = np.concatenate([np.sort(draw.choice(5000, n, replace=False)) for n in sizes])
    tf, length = draw.integers(1, 70, len(term)), draw.integers(1, 4000, len(term))
    starts, first, heads, peaks, peak_from, data, byte_from = blocks(term, doc, tf, length, 128)
    assert starts.tolist() == np.concatenate([[0], np.cumsum(sizes)]).tolist() and heads[:, 2].max() == 128
    at = 0
    for t in range(len(sizes)):
        own, before = data[byte_from[t] : byte_from[t + 1]], 0
        for first_doc, last, n, byte, gap_bits, tf_bits, peak_end in heads[first[t] : first[t + 1]]:
            k = np.arange(n)
            docs = first_doc + np.cumsum(unpack_bits(own, np.full(n, gap_bits), byte * 8 + k * gap_bits))
            tfs = unpack_bits(own, np.full(n, tf_bits), (byte + -(-n * gap_bits // 8)) * 8 + k * tf_bits) + 1
            assert docs.tolist() == doc[at : at + n].tolist() and docs[-1] == last and tfs.tolist() == tf[at : at + n].tolist()
            peak = peaks[peak_from[t] :][before:peak_end]
            assert impact(peak[:, 0], peak[:, 1]).max() == impact(tf[at : at + n], length[at : at + n]).max()
            at, before = at + n, peak_end


def test_blocks_below_the_threshold_stay_packed():
    """Only the rare term's neighbourhood is decompressed where the common term can't reach the best scores alone."""
    from quillspark.llm.ranked_search import Cursor

    n = 20_000
    rare = np.arange(9_000, 9_012)
    term, doc = np.concatenate([np.zeros(n, int), np.ones(12, int)]), np.concatenate([np.arange(n), rare])
    _, first, heads, peaks, peak_from, data, byte_from = blocks(term, doc, np.ones(n + 12, int), np.full(n + 12, 100), 128)
    peak_from = np.append(peak_from, len(peaks)) if len(peak_from) < 3 else peak_from
    cursors = [
        Cursor(heads[first[t] : first[t + 1]].astype("<i4").tobytes(), peaks[peak_from[t] : peak_from[t + 1]].astype("<i4").tobytes(), data[byte_from[t] : byte_from[t + 1]].tobytes(), 1, 100, np.full(n, 100))
        for t in (0, 1)
    ]
    docs, _ = best(cursors, [1, 50], n, 10)
    assert docs.tolist() == rare[:10].tolist()
    assert cursors[0].open.sum() <= 3 and cursors[1].open.all()


def test_index_serves_later_queries(spark, make):
    docs = [(k, f"common word{k % 5} x{k}") for k in range(40)]
    index = build_index(make([t for _, t in docs]), Search())
    for text in ("x7 common", "word3"):
        items = [(1, text)]
        out = search(index, spark.createDataFrame([(1, text, *["x"] * 5)], ITEMS), Search())
        assert sorted(map(tuple, out.collect()), key=str) == brute(docs, items)
