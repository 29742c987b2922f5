import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm.prefix_trie import SUM, prefix_trie, running

SCHEMA = "conv_id long, turn long, role string, text string, depth string, a string, head string, level string, words string"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn, role or "", text or ""))
    own = {}
    for c, said in convs.items():
        said.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest()))
        own[c] = [(role, text) for _, role, text in said]
    whole = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rest = abs(c) % 20 * (1 if c >= 0 else -1)
        whole[c] = own.get(c - rest, [])[:h] + said[h:]
    members, kids = defaultdict(list), defaultdict(list)
    for c, said in whole.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        leaves, saved = (0 if kids[node] else 1), (len(members[node]) - 1) * (words(node[-1][1]) if node else 0)
        sums[node] = leaves + sum(sums[k][0] for k in kids[node]), saved + sum(sums[k][1] for k in kids[node])
    ended = lambda node: ",".join(map(str, sorted(c for c in members[node] if len(whole[c]) == len(node))))
    return sorted(
        ((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), *sums[n], hashlib.sha256(ended(n).encode()).hexdigest()) for n, m in members.items()), key=str
    )


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, *["x"] * 5) for r in rows], SCHEMA).repartition(parts)
    out = prefix_trie(df)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert all(t == ("string" if c == "ends_sha256" else "bigint") for c, t in out.dtypes)
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_random_tries(spark):
    draw = random.Random(5)
    rows = []
    for c in range(-30, 130):
        if draw.random() < 0.8:
            for turn in range(draw.choice([1, 1, 2, 4, 9])):
                rows.append((c, turn if draw.random() < 0.95 else None, draw.choice(["user", "bot", "", None]), draw.choice(["a b", "a", "c\td  e", None, "", "é ß"])))
    check(spark, rows)


def test_long_and_hot_conversations(spark):
    # one conversation of a third of all rows, copies of one conversation, and a branch at each turn of a long one
    rows = [(7, t, "user", f"w{t} x") for t in range(300)]
    rows += [(40 + k, t, "user", f"same {t}") for k in range(60) for t in range(4)]
    rows += [(2000 + k, t, "user", f"w{t} x" if t < k else f"other {k}") for k in range(0, 60, 3) for t in range(k + 1)]
    rows += [(20, 1, "user", "again")] * 200
    check(spark, rows)


def test_odd_rows(spark):
    odd = [(None, 0, "user", "lost"), (3, None, None, None), (3, None, None, None), (3, 2, "", "x " * 50_000), (5, 0, "user", "a"), (5, 0, "user", "a")]
    odd += [(9, 0, "user", " \n"), (60, 0, "1:", "b"), (61, 0, "1", ":b"), (44, 0, "user", "only")]
    check(spark, odd)
    check(spark, [(7, 0, "user", "a")], 1)


def test_empty(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie(spark.createDataFrame([(None, 1, "a", "b", *["x"] * 5)], SCHEMA)).collect() == []


@pytest.mark.parametrize("hot", [0, 5000])
def test_running_sums_cross_ranges(spark, hot):
    rows = [(k % 7, k) for k in range(500)] + [(3, 10_000 + k) for k in range(hot)]
    got = running(spark.createDataFrame(rows, "k long, n long").repartition(5), ["k"], [F.col("n")], {"total": (SUM, F.col("n"))}, "test").collect()
    seen, want = defaultdict(int), {}
    for k, n in sorted(rows):
        seen[k] += n
        want[k, n] = seen[k]
    assert {(r["k"], r["n"]): r["total"] for r in got} == want and len(got) == len(rows)
