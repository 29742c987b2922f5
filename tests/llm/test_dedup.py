"""Operators 3, 5 and 10 against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from quillspark.llm.exact_dedup import digests, exact_dedup, merge_runs
from quillspark.llm.line_dedup import _find, dedup_lines
from quillspark.llm.near_dedup import NearDup, near_dedup

from .conftest import ODD

IDS = [None, 1, 2, 3, 3, 5, 6, 7, 8, None]


@pytest.mark.parametrize("radix,bound", [(None, 1000), (2, 0)])
def test_exact_dedup(make, radix, bound):
    texts = [*ODD, "a b", ""]
    ids = [*IDS, 11, 12]
    rows = exact_dedup(make(texts, ids).repartition(11), radix=radix, broadcast_classes=bound).collect()
    members = defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        members[t or ""].append(i)
    want = sorted(
        repr((i, max((x for x in members[t or ""] if x is not None), default=None), len(members[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())) for i, t in zip(ids, texts, strict=True)
    )
    assert sorted(repr((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in rows) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in rows)
    assert {r["keep_id"] for r in exact_dedup(make(texts, ids), keep="smallest").collect() if r["doc_id"] in (3, 11)} == {3}
    assert exact_dedup(make([])).count() == 0


def test_merge_runs_is_a_tree(make):
    """With radix 2, eleven runs meet in four rounds: one aggregation and three sorted merges."""
    keyed = digests(make([f"t{k % 40}" for k in range(200)]).repartition(11))
    plan = merge_runs(keyed, 11, 2)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("row_number()") == 3 or text.count("Window [") >= 3
    assert sorted(r["members"] for r in plan.collect()) == [5] * 40


def lines_by_hand(ids, texts, least=20):
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held, last = defaultdict(set), {}
    for i, t in zip(ids, texts, strict=True):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least:
                held[k].add(i)
                last[k] = max((x for x in (last.get(k), i) if x is not None), default=None)
    out = []
    for i, t in zip(ids, texts, strict=True):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held[key(x)]) >= 3 and last[key(x)] != i)]
        out.append(repr((i, "\n".join(kept), len(lines), len(lines) - len(kept))))
    return sorted(out)


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_line_dedup(make, bound):
    rnd = random.Random(3)
    common = ["The same line stands in many documents", "Öäü éàè ñç ßß ÀÉ and more text", " \tTHE SAME line stands in many documents\r", "short", "nineteen characters"]
    texts = ODD + ["\n".join(rnd.choice([*common, f"own line number {k} {rnd.random()}", ""]) for _ in range(rnd.randrange(9))) for k in range(40)]
    ids = IDS + list(range(20, 60))
    rows = dedup_lines(make(texts, ids), broadcast_lines=bound).collect()
    assert sorted(repr((r["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"])) for r in rows) == lines_by_hand(ids, texts)
    assert dedup_lines(make([]), broadcast_lines=bound).count() == 0
    # ids that doubles can't tell, a line of null ids alone, one of two documents of which one is repeated
    line, alone, twice = ("the first line of all", "a line of null ids alone", "a line of two documents")
    ids = [2**53, 2**53 + 1, 7, None, None, None, 8, 9, 9]
    texts = [line, line, line, alone, alone, f"{alone}\n{line}", twice, twice, twice]
    rows = dedup_lines(make(texts, ids), broadcast_lines=bound).collect()
    assert sorted(repr((r["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"])) for r in rows) == lines_by_hand(ids, texts)
    assert {r["doc_id"] for r in rows if r["n_dropped"]} == {2**53, 7, None}


def test_find_goes_through_equal_halves():
    h1, h2 = np.zeros(40, np.int64), np.arange(40)
    assert _find((h1, h2, h2), np.zeros(3, np.int64), np.array([39, 17, 99])).tolist() == [39, 17, -1]


def near_by_hand(ids, texts, percent):
    sets = {}
    for i, t in zip(ids, texts, strict=True):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    part = {i: i for i in sets}
    find = lambda i: i if part[i] == i else find(part[i])
    order = sorted(sets)
    for a in order:
        for b in order:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                part[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("percent,block", [(85, 1024), (80, 4)])
def test_near_dedup(make, percent, block):
    """Families of edited copies whose links chain; small blocks cut their buckets in many."""
    rnd = random.Random(11)
    texts = [t for t in ODD if t is None or len(t) < 1000]
    for _ in range(6):
        base = [f"w{rnd.randrange(10_000)}" for _ in range(rnd.choice([6, 40, 200]))]
        for _ in range(25):
            copy = list(base)
            for _ in range(rnd.randrange(5)):
                copy[rnd.randrange(len(copy))] = f"v{rnd.randrange(10_000)}"
            texts.append(" ".join(copy))
    ids = list(range(100, 100 + len(texts)))
    rows = near_dedup(make(texts, ids), NearDup(percent=percent, block=block)).collect()
    want = near_by_hand(ids, texts, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_dedup_odd(make):
    rows = near_dedup(make(ODD, IDS)).collect()
    assert len(rows) == len(ODD)
    assert all(r["component_id"] == r["doc_id"] for r in rows if r["n_shingles"] == 0)
    assert {r["component_id"] for r in rows if r["doc_id"] in (7, 8)} == {7}
    assert near_dedup(make([])).count() == 0
