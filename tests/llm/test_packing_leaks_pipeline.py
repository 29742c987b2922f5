"""Operators 4 and 6 against brute force, and the pipeline stage by stage."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from quillspark.llm.decontaminate import Decontamination, align, decontaminate
from quillspark.llm.packing import best_fit_plan, pack
from quillspark.llm.queries import tokenizer_path

from .conftest import ODD


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit(seed):
    """The histogram's plan opens as many bins with the same rooms as piece-by-piece best fit."""
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 64, 257])
    lengths = [rnd.randint(1, capacity) for _ in range(rnd.randrange(1, 400))]
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, r in enumerate(rooms) if r >= n]
        k = min(fit, key=lambda k: rooms[k]) if fit else len(rooms)
        if not fit:
            rooms.append(capacity)
        rooms[k] -= n
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan, bins = best_fit_plan(counts, capacity)
    used = defaultdict(int)
    for n, c in counts.items():
        own = plan[plan[:, 0] == n]
        for rank in range(c):
            _, first, per, lo, offset = own[own[:, 1] <= rank][-1]
            assert offset + (rank - first) % per * n <= capacity - n
            used[lo + (rank - first) // per] += n
    assert bins == len(rooms) and sorted(capacity - u for u in used.values()) == sorted(rooms)


@pytest.mark.parametrize("bound", [100_000, 0])
def test_pack_round_trip(make, bound):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rnd = random.Random(4)
    alphabet = "aAéÉß .,'\n\t1#|ÿıİK\xa0\x85́xXsS"
    texts = [*ODD, "<|ENDOFTEXT|> don't", *("".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 300))) for _ in range(80))]
    rows = pack(make(texts), tokenizer_path(), capacity=64, with_ids=True, broadcast_shards=bound).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] <= 64 and zlib.crc32(r["ids"]) == r["ids_crc32"]
        by_doc[r["doc_id"]].append((r["piece"], r["start"], ids))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, t in enumerate(texts):
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        got = sorted(by_doc[k])
        assert [p for p, *_ in got] == list(range(len(got))) and sum((i for *_, i in got), []) == want
        assert [s for _, s, _ in got] == list(range(0, len(want), 64))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert pack(make([]), tokenizer_path()).count() == 0


def naive_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_align():
    rnd = np.random.default_rng(0)
    for _ in range(200):
        a, b = rnd.integers(0, 4, rnd.integers(1, 12)).astype(np.uint64), rnd.integers(0, 4, rnd.integers(1, 15)).astype(np.uint64)
        score, matched, start, end = align(a, b, Decontamination())
        assert score == naive_align(a.tolist(), b.tolist()) and 0 <= start <= end <= len(b) and 2 * matched >= score
        # the place alone gives the same
        assert align(a, b[start:end], Decontamination())[:2] == (score, matched)
    long = np.arange(50_000).astype(np.uint64)
    assert align(long[100:160], long, Decontamination()) == (120, 60, 100, 160)


@pytest.mark.parametrize("block_words", [1_000_000, 60])
def test_decontaminate(spark, make, block_words):
    rnd = random.Random(6)
    vocabulary = [f"v{k}" for k in range(3000)]
    fill = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [fill(rnd.randrange(12, 60)) for _ in range(12)]
    texts, want = list(ODD), set()
    for k in range(120):
        words = fill(100)
        if k % 3 == 0:
            item = k % 12
            copy = list(items[item])
            for _ in range(len(copy) // 8):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            words[50:50] = copy
            want.add((len(texts), item))
        texts.append(" ".join(words).upper() if k % 2 else "\n".join(words))
    table = spark.createDataFrame([*((k, " ".join(w), "c") for k, w in enumerate(items)), (90, None, "c"), (91, "", "c"), (92, "v1 v2", "c"), (None, " ".join(fill(20)), "c")], "item_id long, text string, doc_id string")
    rows = decontaminate(make(texts), table, Decontamination(block_words=block_words)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(rows) == len(want)
    assert decontaminate(make([]), table).count() == 0
    assert decontaminate(make(texts), table.where("false")).count() == 0


def test_decontaminate_with_repeated_words(spark, make, monkeypatch):
    """Runs of equal words are searched in parts, with the same result and few hits at once."""
    from quillspark.llm import decontaminate as D

    items = [(k, " ".join(["la"] * 12 + [f"i{k}_{j}" for j in range(8)])) for k in range(40)] + [(99, " ".join(f"x{j}" for j in range(120)))]
    texts = ["la " * 20_000, "la " * 3000 + items[3][1] + " la" * 3000, "a b " * 4000 + items[40][1], None, ""]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = lambda: sorted(map(tuple, decontaminate(make(texts), table).collect()))
    most = []
    real = D.Seeds.hits
    monkeypatch.setattr(D.Seeds, "hits", lambda self, found, values: most.append(self.times(values)) or real(self, found, values))
    words, starts = D.batch_words(texts, D.WordHash())
    block = next(D._blocks(table, "item_id", "text", Decontamination()))
    known = block.all_words()
    block.choose(known, np.zeros(len(known), np.int64), Decontamination())
    parts = {}
    for limit in (10**9, 100_000):
        most.clear()
        monkeypatch.setattr(D, "HITS", limit)
        parts[limit] = D.candidates(words, starts, block, block.among(), Decontamination())
        assert limit == 10**9 or max(most) <= limit
    assert parts[10**9] == parts[100_000] and parts[100_000]
    monkeypatch.undo()
    assert {(r[0], r[2]) for r in found()} >= {(1, 3), (2, 99)}


@pytest.mark.parametrize("block_words", [1_000_000, 300])
def test_decontaminate_finds_what_aligns(spark, make, block_words):
    """Against the alignment of every item with every whole document."""
    rnd = random.Random(9)
    frequent, rare = [f"f{k}" for k in range(30)], [f"v{k}" for k in range(5000)]
    fill = lambda n: [rnd.choice(rnd.choice([frequent, rare])) for _ in range(n)]
    items = [fill(n) for n in (5, 11, 15, 59, 59, 20, 18, 17, 130, 16, 7, 54)]
    change = lambda w, every: [rnd.choice(rare) if every(i) else x for i, x in enumerate(w)]
    copies = [
        change(items[1], lambda i: i == 5), change(items[2], lambda i: i in (5, 10)), change(items[3], lambda i: i % 6 == 5), change(items[4], lambda i: i % 3 == 2),
        [x for w in items[5] for x in (w, rnd.choice(rare))], [w for i, w in enumerate(items[6]) if i % 3], [x for w in items[8][:60] for x in (w, "new")], [x for w in items[11] for x in (w, "new", "new")][:-2],
    ]
    for k in range(60):
        item = items[5 + k % 5]
        spots = set(rnd.sample(range(len(item)), round(len(item) * rnd.choice([0.2, 0.3, 0.4]))))
        copies.append(change(item, lambda i, spots=spots: i in spots))
    texts = [*ODD[:5], *(" ".join(fill(rnd.randrange(40)) + c + fill(rnd.randrange(40))) for c in copies), *(" ".join(fill(60)) for _ in range(40))]
    p = Decontamination(block_words=block_words)
    number = {}
    hashes = lambda w: np.array([number.setdefault(x, len(number)) for x in w], np.uint64)
    want = {}
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            score, matched, *_ = align(hashes(item), hashes((t or "").split()), p)
            if score >= len(item) or matched >= 50:
                want[i, k] = score / (2 * len(item))
    assert all((5 + i, k) in want for i, k in enumerate((1, 2, 3, 4, 5, 6, 8)))
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate(make(texts), table, p).collect()} == want


def test_seeds_count_all_documents(spark, make, monkeypatch):
    """Every document's words decide which seeds are dropped."""
    from quillspark.llm import decontaminate as D

    told = []
    choose = D.Items.choose
    monkeypatch.setattr(D.Items, "choose", lambda self, known, often, p: (told.append(sorted(often.tolist())), choose(self, known, often, p)))
    items = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    decontaminate(make(["a b x"] * 30 + ["a c"] * 7 + ["e e e", None]), items)
    assert told == [[0, 3, 7, 30, 37]]


def test_pipeline(spark, tmp_path):
    """Each stage on what its predecessor kept: same columns, and its decision took effect."""
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, kept[-1], sf).write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < len(P.STAGES) - 1:
            assert kept[-1].columns == columns and kept[-1].exceptAll(kept[-2]).count() == 0
    good = {r["doc_id"]: r["text"] for r in kept[1].collect()}
    exact = {r["doc_id"]: r["text"] for r in kept[2].collect()}
    assert exact == {i: t for i, t in good.items() if i == max(j for j, u in good.items() if u == t)}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.encode().lower().split()) else set() for i, t in exact.items()}
    near = {r["doc_id"] for r in kept[3].collect()}
    linked = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    left, groups = set(sets), []
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            a = todo.pop()
            group.add(a)
            more = {b for b in left if linked(a, b)}
            left -= more
            todo += more
        groups.append(group)
    assert near == {min(g) for g in groups}
    items = [set(zip(*(w[k:] for k in range(8)), strict=False)) for w in (r["text"].lower().split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect())]
    clean = {r["doc_id"]: r["text"] for r in kept[4].collect()}
    for i, t in exact.items():
        w = t.lower().split()
        runs = set(zip(*(w[k:] for k in range(8)), strict=False))
        if i in near:
            assert (i in clean) or any(runs & x for x in items)
        if i in clean:
            assert not any(x and len(runs & x) > 0.6 * len(x) for x in items)
    assert {r["doc_id"] for r in kept[5].select("doc_id").collect()} == set(clean)
    assert P.run(spark, sf).count() == kept[5].count()


def test_pipeline_odd_rows(spark, make, tmp_path):
    """Null and repeated ids, repeated rows, null and empty texts, another column; then empty tables."""
    import corpus_pipeline as P

    rnd = random.Random(21)
    prose = lambda n=80: " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(2, 9))) for _ in range(n)) + "."
    a, b, c, d, e, item = (prose() for _ in range(6))
    near = " ".join([*a.split()[:-1], "changed"])
    junk = "%%% *** ### " * 40
    good = [prose(rnd.randrange(40, 400)) for _ in range(60)]
    rows = [
        (None, a), (None, near), (None, junk), (7, b), (7, b), (7, c), (None, c), (8, junk), (8, d), (None, f"{e} {item} {e}"), (9, item), (9, e), (None, None), (10, ""), (11, ""),
        *((100 + k, t) for k, t in enumerate(good)),
    ]
    docs = make([t for _, t in rows], [i for i, _ in rows])
    labels = [(100 + k, 1, 0) for k in range(60)] + [(1000 + k, 0, 0) for k in range(60)]
    docs = docs.unionByName(make([junk[: rnd.randrange(100, 480)] + str(k) for k in range(60)], [1000 + k for k in range(60)]))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept, left = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in P.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        left.append(sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr))
    odd = lambda rows: sorted(((i, t) for i, t in rows if (i is None or i < 100) and t), key=repr)
    assert junk not in {t for _, t in left[0]} and odd(left[0]) == odd([r for r in rows if r[1] != junk])
    # one row a text, a null id only where there is no other
    assert len({t or "" for _, t in left[1]}) == len(left[1])
    assert odd(left[1]) == odd([(None, a), (None, near), (7, b), (7, c), (8, d), (None, f"{e} {item} {e}"), (9, item), (9, e)])
    assert len(odd(left[2])) == len(odd(left[1])) - 1 and len({a, near} & {t for _, t in left[2]}) == 1
    assert odd(left[3]) == odd([r for r in left[2] if item not in r[1]])
    pieces = P.run(spark, str(tmp_path))
    assert pieces.count() == len(left[3])
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path / "none")).count() == 0
