"""Operator 7: toxicity by a weighted finite-state grammar over clauses.

Words become class symbols (insult, threat, target, negation, reported speech, other) by a lexicon
transducer that accepts whole words and word beginnings.  Three context transducers rewrite insult
and threat symbols by what precedes them in the clause: negation weakens, reported speech marks a
quotation, a target sharpens.  They are composed once into one deterministic transducer; a clause
runs through it in one step per word, and only clauses that hold an insult or a threat are run.
A document's evidence is the weight of its matched clauses by kind of match; a logistic model over
these gives the score.

Learned from labels, of training rows only: which words and word beginnings mark insults (their
document counts in toxic and other rows, one row per cluster of near copies, by a likelihood-ratio
test), their weights, and the logistic model.  The fit reads at most ``train_rows`` labelled rows
(those of least hash); scoring reads every text whole.  Broadcast is the model alone: at most
``lexicon_size`` entries.

Defined cases: a null or empty text has no clause and gets the model's base score.  Labels
other than 0 and 1, and label rows without a document, are not learned from; without any usable label the
fixed lexicon and weights hold.  Repeated rows are scored alike.  A null doc_id counts as not held out.  An empty table gives no
rows.  Columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, materialize, shingle_set, text_hash, tune, words_of

# Small word lists of the grammar's classes.
INSULTS = "idiot stupid moron loser scum trash worthless pathetic disgusting clown".split()
THREATS = "kill hurt destroy beat burn stab shoot strangle tuer töten matar".split()
TARGETS = "you your yours he she they them him her these those tu toi vous lui eux du dich ihr euch sie usted ustedes ellos ellas".split()
NEGATIONS = "not never no nor neither without isn aren wasn don doesn didn ne pas jamais nicht kein keine nie nunca jamás sin".split()
REPORTED = "said says say told called calls wrote writes quoted claimed dit écrit sagte schrieb dijo escribió".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = "oIHTNR"
TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")
ENDS = frozenset(".!?;:\n")


@dataclass
class Transducer:
    """Deterministic: ``arcs[state][symbol] = (next state, output symbol, weight)``; others copy."""

    arcs: list[dict[str, tuple[int, str, float]]]

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs[state].get(symbol) or self.arcs[state].get("*") and (self.arcs[state]["*"][0], symbol, self.arcs[state]["*"][2]) or (state, symbol, 0.0)


def context(trigger: str, reach: int, rewrite: dict[str, str], weight: float) -> Transducer:
    """After ``trigger``, the symbols in ``rewrite`` change for the next ``reach`` words."""
    arcs: list[dict[str, tuple[int, str, float]]] = [{trigger: (reach, trigger, 0.0)}]
    for left in range(1, reach + 1):
        out = {s: (left - 1, t, weight) for s, t in rewrite.items()}
        arcs.append({trigger: (reach, trigger, 0.0), "*": (left - 1, "*", 0.0), **out})
    return Transducer(arcs)


def compose(machines: list[Transducer], alphabet: str) -> Transducer:
    """One machine that does what feeding each machine's output to the next does."""
    number, arcs, todo = {(0,) * len(machines): 0}, [], [(0,) * len(machines)]
    while todo:
        states = todo.pop(0)
        row = {}
        for symbol in alphabet:
            out, total, after = symbol, 0.0, []
            for machine, state in zip(machines, states, strict=True):
                state, out, weight = machine.step(state, out)
                after.append(state)
                total += weight
            if tuple(after) not in number:
                number[tuple(after)] = len(number)
                todo.append(tuple(after))
            row[symbol] = (number[tuple(after)], out, total)
        arcs.append(row)
    return Transducer(arcs)


#: Output symbols: plain, targeted, negated and reported insults; then the same for threats.
MATCHES = "IJKLHEFG"


def grammar() -> Transducer:
    """Negation over five words, a target over six, reported speech over twelve."""
    negated = context(NEGATION, 5, {INSULT: "K", THREAT: "F"}, -0.5)
    reported = context(REPORT, 12, {INSULT: "L", THREAT: "G"}, -0.25)
    targeted = context(TARGET, 6, {INSULT: "J", THREAT: "E"}, 0.25)
    return compose([negated, reported, targeted], OTHER + INSULT + THREAT + TARGET + NEGATION + REPORT)


@dataclass
class Lexicon:
    """The lexicon transducer: word -> class and weight, by whole words and by beginnings."""

    whole: dict[str, float]
    begins: dict[str, float]
    longest: int = 0
    fixed: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.begins), default=0)
        for words, kind in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTED, REPORT), (THREATS, THREAT)):
            self.fixed |= dict.fromkeys(words, kind)

    def weight(self, word: str) -> float:
        own = [self.whole.get(word, 0.0)]
        own += [self.begins.get(word[:k], 0.0) for k in range(2, min(len(word), self.longest) + 1)]
        return max(own)


class Classes(dict):
    """word -> (symbol, weight), kept for words already seen; emptied when too large."""

    LIMIT = 300_000

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> str:
        if len(self) >= self.LIMIT:
            self.clear()
        symbol = "." if word in ENDS else INSULT if self.lexicon.weight(word) > 0 else self.lexicon.fixed.get(word, OTHER)
        self[word] = symbol
        return symbol


def evidence(text: str, classes: Classes, machine: Transducer) -> np.ndarray:
    """Per kind of match the sum and the maximum of its clauses' weights, then the share of clauses."""
    tokens = TOKEN.findall(text.lower())
    symbols = "".join(map(classes.__getitem__, tokens))
    out = np.zeros(2 * len(MATCHES) + 1)
    if INSULT not in symbols and THREAT not in symbols:
        return out
    clauses = hits = at = 0
    for clause in symbols.split("."):
        clauses += bool(clause)
        if INSULT in clause or THREAT in clause:
            hits += 1
            state = 0
            score = defaultdict(float)
            for k, symbol in enumerate(clause):
                state, made, weight = machine.arcs[state][symbol]
                if made in MATCHES:
                    score[made] += max(0.0, (classes.lexicon.weight(tokens[at + k]) or 1.0) + weight)
            for made, weight in score.items():
                i = MATCHES.index(made)
                out[i] += weight
                out[len(MATCHES) + i] = max(out[len(MATCHES) + i], weight)
        at += len(clause) + 1
    out[: len(MATCHES)] = np.log1p(out[: len(MATCHES)])
    out[-1] = hits / clauses
    return out


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.bias, -30, 30)))


def slopes(a: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the logistic loss, summed over the rows of ``a``."""
    p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
    return a.T @ (p - y), (a * (p * (1 - p) + 1e-9)[:, None]).T @ a


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], centre: np.ndarray, penalty: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of least loss, shrunk towards ``centre``; ``sums`` gives the ``slopes`` of all rows at some weights."""
    w = centre.copy()
    for _ in range(rounds):
        gradient, hessian = sums(w)
        step = np.linalg.solve(hessian + np.diag(penalty), gradient + penalty * (w - centre))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50, prior: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton's method, shrunk towards ``prior``."""
    a = np.hstack([x, np.ones((len(x), 1))])
    centre = np.append(prior if prior is not None else np.zeros(x.shape[1]), 0.0)
    w = newton(lambda w: slopes(a, y, w), centre, np.append(np.full(x.shape[1], ridge), 1e-6), rounds)
    return w[:-1], float(w[-1])


def _training(docs: DataFrame, labels: DataFrame, train_rows: int, fold: int) -> DataFrame:
    """At most ``train_rows`` labelled training rows ``(doc_id, text, y)``, one per label row: of a repeated id, the least text hash."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    usable = usable.where(F.crc32(F.col("doc_id").cast("string")) % fold != 0)
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # train_rows bounds it
    return rows.groupBy("doc_id").agg(F.min_by("text", text_hash()).alias("text"), F.max("y").alias("y"))


def _marks(text: str) -> set[str]:
    words = set(re.findall(r"[^\W\d_]+", text.lower()))
    return words | {"^" + w[:k] for w in words for k in range(3, min(10, len(w)))}


def _counts(training: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(mark, toxic, other)``: of clusters of near copies, one row each, how many hold the mark; and those rows."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHash()
        for batch in batches:
            sets = [shingle_set(words_of(t or ""), table) for t in batch.column("text").to_pylist()]
            least = [int(s[0]) - 2**63 if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), batch.column("text"), pa.array(least, pa.int64())], names=["doc_id", "y", "text", "near"])

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                for m in _marks(text or ""):
                    n[m][y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array((v[1] for v in n.values()), pa.int64()), pa.array((v[0] for v in n.values()), pa.int64())], names=["mark", "toxic", "other"])

    rows = training.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y"), "text").mapInArrow(prints, "doc_id long, y int, text string, near long")
    rows = materialize(rows, "labelled")
    first = rows.groupBy("near", "y").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    single = materialize(rows.join(first, "doc_id", "left_semi").select("y", "text"), "single")
    return single.mapInArrow(marks, "mark string, toxic long, other long").groupBy("mark").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), single


def _select(marks: dict[str, tuple[int, int]], single: DataFrame) -> set[str]:
    """Marks that are surely precise, and those needed to explain toxic rows that these leave.

    A beginning is dropped for a longer one that keeps nine tenths of its toxic rows with fewer
    others.  Surely precise: the lower bound of the share of toxic rows (Wilson, z = 1.64) is at
    least 0.93.  Then, greedily, the mark that explains most toxic rows left, at least three.
    """
    lower = lambda a, b: ((a + 1.35) / (a + b) - 1.64 * math.sqrt(a * b / (a + b) + 0.67) / (a + b)) / (1 + 2.69 / (a + b))
    # each longer beginning speaks against its own few shorter ones
    shorter = ((x[:k], x) for x in marks if x[0] == "^" for k in range(2, len(x)))
    vague = {m for m, x in shorter if m in marks and marks[x][0] >= 0.9 * marks[m][0] and marks[x][1] < marks[m][1]}
    usable = {m: c for m, c in marks.items() if m not in vague}
    chosen = {m for m, (a, b) in usable.items() if lower(a, b) >= 0.93}
    names = sorted(usable)
    shared = single.sparkSession.sparkContext.broadcast({m: i for i, m in enumerate(names)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [[shared.value[m] for m in _marks(t or "") if m in shared.value] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(held, pa.list_(pa.int32()))], names=["y", "held"])

    # at most the training bound's rows, toxic ones only
    rows = single.where("y = 1").mapInArrow(run, "y int, held array<int>").toArrow()
    left = [{names[i] for i in held} for held in rows["held"].to_pylist()]
    left = [held for held in left if held and not held & chosen]
    tally, holders = Counter(m for held in left for m in held), defaultdict(list)
    for k, held in enumerate(left):
        for m in held:
            holders[m].append(k)
    # values only fall, so the first that comes from the heap with its value of now is the best
    value = lambda m: (2 * usable[m][1] - tally[m], -len(m), m)
    heap, done = [value(m) for m in tally], set()
    heapify(heap)
    while heap:
        best = heap[0][2]
        if heap[0] != value(best):
            heapreplace(heap, value(best))
            continue
        if tally[best] < 3 or tally[best] <= 2 * usable[best][1]:
            break
        chosen.add(best)
        heappop(heap)
        for k in set(holders[best]) - done:
            done.add(k)
            tally.subtract(left[k])
    return chosen


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, fold: int = 5, lexicon_size: int = 20_000, least_ratio: float = 20.0) -> Model:
    counts, single = _counts(_training(docs, labels, train_rows, fold))
    sizes = {r["y"]: r["n"] for r in single.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    default = np.array([0, 1, -0.5, -0.2, 0, 1, -0.5, -0.2, 1.5, 2, 0.2, 0.4, 1.5, 2, 0.2, 0.4, 0.0])
    if not n1 or not n0:
        return Model(Lexicon(dict.fromkeys(INSULTS, 2.0), {}), default, -3.0)
    # likelihood ratio of the mark's counts against one common rate, for marks of toxic rows
    base = n1 / (n1 + n0)
    k, n = F.col("toxic").cast("double"), (F.col("toxic") + F.col("other")).cast("double")
    part = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    ratio = 2 * (part(k, n * base) + part(n - k, n * (1 - base)))
    weight = F.log((k + 0.5) / (n1 + 1)) - F.log((n - k + 0.5) / (n0 + 1))
    weighed = materialize(counts.withColumn("ratio", ratio).withColumn("weight", weight).where(((ratio >= least_ratio) & (k / n >= 0.8)) | F.col("mark").isin(INSULTS)), "marks")
    found = weighed.where((F.col("ratio") >= least_ratio) & (k / n >= 0.8)).orderBy(F.desc("ratio"), "mark").limit(lexicon_size).collect()
    chosen = _select({r["mark"]: (r["toxic"], r["other"]) for r in found}, single)
    kept = [r for r in found if r["mark"] in chosen]
    whole = {r["mark"]: r["weight"] for r in kept if r["mark"][0] != "^"}
    begins = {r["mark"][1:]: r["weight"] for r in kept if r["mark"][0] == "^"}
    seen = {r["mark"]: (r["toxic"], r["other"]) for r in weighed.where(F.col("mark").isin(INSULTS)).collect()}
    for word in INSULTS:  # the fixed list holds where the labels don't speak against it
        a, b = seen.get(word, (0, 0))
        whole.setdefault(word, max(0.0, math.log((a + 1) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))) if a + b else 1.0)
    lexicon = Lexicon({w: x for w, x in whole.items() if x > 0}, begins)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, machine = Classes(shared.value), grammar()
        for batch in batches:
            x = [evidence(t or "", classes, machine) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array((v.tolist() for v in x), pa.list_(pa.float64()))], names=["y", "x"])

    # at most train_rows rows of 17 numbers
    rows = single.mapInArrow(features, "y int, x array<double>").toArrow()
    x, y = np.array(rows["x"].to_pylist()), rows["y"].to_numpy().astype(float)
    weights, bias = logistic(x, y, ridge=1.0, prior=default)
    return Model(lexicon, weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: ``doc_id, score, clauses`` (matched insult or threat clauses' evidence sum)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        classes, machine = Classes(model.lexicon), grammar()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            x = np.array([evidence(t or "", classes, machine) for t in texts]).reshape(len(texts), -1)
            scores = model.score(x) if len(texts) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(x[:, : len(MATCHES)].sum(1) if len(texts) else scores)], names=["doc_id", "score", "clauses"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, clauses double")


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, fold: int = 5) -> DataFrame:
    """Per input row: ``doc_id, held_out, score, predicted, clauses``."""
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    model = train(rows, labels.select("doc_id", "toxic"), train_rows, fold)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == 0, F.lit(False))
    return score(rows, model).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "clauses")
