"""Operator 8: secrets, with weak parts reported only where they complete a credential.

Base spans stand by themselves: assignments to secret names, access identifiers and long
hexadecimal strings.  Weak candidates (keys of 32 characters or more, padded or not, user names, endpoints) say little
alone.  Each part has a role (identifier, secret, endpoint) and an interval; an interval join within a
scope (a paragraph, i.e. text between blank lines, and at most ``reach`` code points between two parts) links parts of
complementary roles: a secret with an identifier or an endpoint, in either order.  A weak candidate is reported only
when it is linked; a user name and an endpoint without any secret near them are no credential and never are.
The join is two sweeps over the parts in order of position, one for what stands before and one for what
follows, each holding the nearest end or start per role; it takes linear time and memory.

Defined cases: a null or empty text has no spans and empty strings for lists.  Offsets count code
points, ends are exclusive.  Long texts are scanned whole.  Repeated rows give repeated results; an
empty table gives no rows.  Columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20}

KINDS = ("assign", "access", "hex", "key", "user", "endpoint")
# Weak candidates: a bare key with mixed characters, a user name, a place to use them at.
# A key is a whole run of key characters, of any length from 32 on, with its base64 padding.
KEY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}(?![A-Za-z0-9+/_-])={0,2}")
USER = re.compile(r"""(?:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]{2,})""", re.I | re.A)
ENDPOINT = re.compile(r"(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?::\d{2,5})(?!\d)", re.I | re.A)

ROLE = {"assign": "secret", "hex": "secret", "key": "secret", "access": "identifier", "user": "identifier", "endpoint": "endpoint"}
#: Roles that complete each other, the same either way round.
COMPLETES = {"secret": ("identifier", "endpoint"), "identifier": ("secret",), "endpoint": ("secret",)}
WEAK = {"key", "user", "endpoint"}

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind, those too short dropped."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # {24,} finds the same runs as [0-9a-f]+ with a length test: a run that is too short can't hold one
    out += [("hex", m.start(), m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def weak_spans(text: str, base: list[Span]) -> list[Span]:
    """Candidates that overlap no base span; a key needs a digit and both cases of letters."""
    out: list[Span] = []
    for m in KEY.finditer(text):
        s = m[0]
        if re.search(r"\d", s) and re.search("[a-z]", s) and re.search("[A-Z]", s):
            out.append(("key", m.start(), m.end()))
    if "=" in text or ":" in text:
        out += [("user", m.start(), m.end()) for m in USER.finditer(text)]
        out += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    # base spans sorted by start; those that begin before an end reach at most to the running maximum
    starts, reach = [b[1] for b in base], list(accumulate((b[2] for b in base), max))
    covers = lambda w: (k := bisect_left(starts, w[2])) > 0 and reach[k - 1] > w[1]
    return [w for w in out if not covers(w)]


def link(text: str, parts: list[Span], reach: int = 400) -> set[Span]:
    """Weak parts with a complementary part in the same paragraph at most ``reach`` away."""
    parts = sorted(parts, key=lambda s: (s[1], s[2], s[0]))
    breaks = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    scopes = [bisect_right(breaks, start) for _, start, _ in parts]
    found: set[Span] = set()

    def sweep(order: Iterable[int], distance: Callable[[Span, int], int], nearest: Callable[[Span, int | None], int]) -> None:
        scope, held = -1, {}
        for i in order:
            part = parts[i]
            if scopes[i] != scope:
                scope, held = scopes[i], {}
            role = ROLE[part[0]]
            if part[0] in WEAK and any(r in held and distance(part, held[r]) <= reach for r in COMPLETES[role]):
                found.add(part)
            held[role] = nearest(part, held.get(role))

    sweep(range(len(parts)), lambda part, end: part[1] - end, lambda part, end: max(part[2], end or 0))
    sweep(reversed(range(len(parts))), lambda part, start: start - part[2], lambda part, _: part[1])
    return found


def find_secrets(text: str | None, reach: int = 400) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans in order of start and kind."""
    text = text or ""
    base = base_spans(text)
    weak = weak_spans(text, base)
    if not weak:
        return base, base
    linked = link(text, base + weak, reach)
    return base, sorted(base + [w for w in weak if w in linked], key=lambda s: (s[1], KINDS.index(s[0])))


def secrets(docs: DataFrame, reach: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: ``doc_id`` and ``found``, an array of ``(kind, start, end, base)``."""
    tune(docs.sparkSession)
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base, spans = find_secrets(text, reach)
                strong = set(base)
                out.append([{"kind": k, "start": a, "end": b, "base": (k, a, b) in strong} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(item))], names=["doc_id", "found"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, found array<struct<kind:string,start:long,end:long,base:boolean>>")
