"""Operator 1: licence scan by a trained paragraph classifier with template confirmation.

Paragraphs are runs of lines without a blank one.  In a paragraph, places that may hold a notice are the smallest runs
of words, over line breaks too, with ``least_overlap`` of some template's word pairs, among them one that no
other family's templates have, in at most twice the template's words.  Templates are opening clauses of public licences, the notices by which
they are applied, names and SPDX lines.  Of places that overlap, that with most pairs counts.

Its words and up to ``context`` words on either side within the sentence, with marks where the sentence begins or ends, go
to a multinomial logistic regression over sparse word n-grams (one to three words) with one class per licence family and one
for unknown text.  It is fitted on notices in the ways they are put, and for the unknown class on negated and mentioned
notices, shuffled ones and runs of words of the corpus itself (``corpus_runs`` from all of the text of each of about ``corpus_rows`` documents, drawn by
hash; runs that hold a template left out).  Its probabilities are calibrated by a temperature, chosen on phrasings that a first fit has not seen.  A
place whose best family stays under ``least_probability`` is unknown.  A prediction counts only when it is
confirmed: a template of the predicted family must reach ``least_overlap`` in the place as above.

All texts are read whole.  A text without any word of a set that every place needs is passed over; this drops no
place, as without these words too few pairs are left.

Defined cases: null and empty texts have no paragraph and no licence; of equal probabilities the first family in
order is taken; of equal places the first; repeated rows give repeated results; an empty table gives no rows.  Columns other
than the id and the text are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

# Names, notices and opening clauses of public licences, by family.
TEMPLATES = {
    "AGPL-3.0": [
        "GNU Affero General Public License", "licensed under the GNU Affero General Public License version 3", "AGPLv3", "SPDX-License-Identifier: AGPL-3.0-or-later", "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license", "SPDX-License-Identifier: Apache-2.0", "you may not use this file except in compliance with the License",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    ],
    "BSD": [
        "licensed under the BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    ],
    "CC-BY": ["licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0", "CC-BY-4.0 license", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC": ["licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0 license", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA": ["licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0 license", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC0": [
        "dedicated to the public domain under the CC0 license", "released into the public domain", "CC0 1.0 Universal Public Domain Dedication", "SPDX-License-Identifier: CC0-1.0",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "GPL": [
        "licensed under the GNU General Public License, version 3", "licensed under the GNU General Public License, version 2", "GNU GPL version 3", "GPLv3", "GPLv2", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only",
        "under the terms of the GNU General Public License as published by the Free Software Foundation",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ],
    "ISC": [
        "licensed under the ISC License", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    ],
    "LGPL": [
        "licensed under the GNU Lesser General Public License", "GNU Lesser General Public License version 3", "LGPLv3", "SPDX-License-Identifier: LGPL-3.0-or-later", "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "Released under the MIT License", "Licensed under the MIT License", "MIT License", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    ],
    "MPL-2.0": [
        "subject to the terms of the Mozilla Public License, v. 2.0", "licensed under the Mozilla Public License 2.0", "MPL-2.0 license", "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Proprietary": ["All rights reserved", "All rights reserved. Unauthorized copying is prohibited", "proprietary and confidential license", "may not be reproduced without the prior written permission of the copyright holder"],
}
# What stands before and after notices, ways to deny and to mention one, sentences that name none.
LEADS = ["", "This work is", "This file is", "This software is", "This program is", "The source code is", "Copyright 2020 the authors.", "Code and data:", "License:", "You may use it as it is"]
TAILS = ["", ".", ". See the LICENSE file for details.", ". All contributors are listed in AUTHORS.", ", see LICENSE", ". Copyright 2021 the authors."]
DENIALS = ["We do not use the", "This is not", "It is no longer", "This file was never", "Nothing here is", "Neither part is", "It isn't", "They stopped being", "Contrary to the rumour it is not", "No part of it is", "It can't be", "This isn't", "It wasn't", "They aren't", "The code is not", "Not", "Never", "No longer"]
MENTIONS = ["An essay about the words", "The court asked what is meant by", "He read aloud", "The lecture compares", "Some confuse it with", "The seminar on", "What would change if it were"]
AFTER = ["seats were sold", "rooms are on the second floor", "was discussed for an hour", "means little to most readers", "and its history in the courts", "tables were taken", "is the title of the essay", "students met in the park", "is what the question was about"]
VAGUE = [
    "see the license for details", "the license of this work is not stated", "licensed under the terms of the agreement", "copyright 2019 the authors", "permission was asked of the editor",
    "public domain or not is unclear", "the licensed driver went to the city", "redistribution of income is debated", "a warranty covers the machine for two years", "licensed under the custom license version 2",
    "released under the old license", "the public library is under repair", "the general public was informed", "the foundation published version 3 of the report", "free of charge to any person",
]
#: Words; GPLv3 and its like are two.
WORD = re.compile(r"[al]?gpl(?=v[0-9])|[a-z0-9]+(?:\.[0-9]+)*")
STOP = re.compile(r"[.!?;](?=\s|\Z)")
BLANK = re.compile(r"\n[^\S\n]*(?=\n)")
UNKNOWN, BEGIN, END = "unknown", "^", "$"
#: Words of a long template that stand for one example.
PORTION = 24


@dataclass(frozen=True)
class Scan:
    least_probability: float = 0.5
    least_overlap: float = 0.6
    context: int = 6
    #: Documents, and characters of each, that the unknown class is fitted on.
    corpus_rows: int = 400
    #: Runs of words from each, from all of its text.
    corpus_runs: int = 10


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def pairs(tokens: list[str]) -> set[tuple[str, str]]:
    return set(zip(tokens, tokens[1:], strict=False))


def grams(tokens: list[str]) -> set[str]:
    return {" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)}


@dataclass(frozen=True)
class Template:
    family: str
    pairs: frozenset
    #: Pairs that no template of another family has.
    own: frozenset
    need: int
    #: Words that a place may take.
    room: int


@dataclass(frozen=True)
class Index:
    templates: list[Template]
    by_pair: dict[tuple[str, str], list[int]]
    some: re.Pattern


@lru_cache(maxsize=4)
def index(least_overlap: float) -> Index:
    """The templates, those of each pair, and words of which every place holds one."""
    held = [(family, words(t)) for family, texts in TEMPLATES.items() for t in texts]
    of_family: dict[str, set] = defaultdict(set)
    for family, w in held:
        of_family[family] |= pairs(w)
    templates, by_pair, some = [], defaultdict(list), set()
    for family, w in held:
        every = pairs(w)
        own = every - set().union(*(v for f, v in of_family.items() if f != family))
        need = max(1, next(c for c in range(len(every) + 1) if c / len(every) >= least_overlap))
        for pair in every:
            by_pair[pair].append(len(templates))
        templates.append(Template(family, frozenset(every), frozenset(own), need, 2 * len(w)))
        # without these words too few pairs are left; long words are the rarer ones
        left = every
        for x in sorted(set(w), key=lambda x: (-len(x), x)):
            if len(left) < need or not left & own:
                break
            some.add(x)
            left = {pair for pair in left if x not in pair}
    return Index(templates, dict(by_pair), re.compile("|".join(map(re.escape, sorted(some)))))


def overlap(tokens: list[str], family: str, least_overlap: float) -> float:
    """The largest share of a template's pairs in the words, of templates of which an own pair is there."""
    held = pairs(tokens)
    return max((len(t.pairs & held) / len(t.pairs) for t in index(least_overlap).templates if t.family == family and t.own & held), default=0.0)


def _runs(places: list[tuple[int, tuple[str, str]]], least: int) -> Iterator[tuple[int, int]]:
    """First and last place of the smallest runs of places with ``least`` distinct pairs."""
    held, first = Counter(), 0
    for at, pair in places:
        held[pair] += 1
        while len(held) > least or held[places[first][1]] > 1:
            gone = places[first][1]
            held[gone] -= 1
            if not held[gone]:
                del held[gone]
            first += 1
        if len(held) == least:
            yield places[first][0], at


def candidates(tokens: list[str], least_overlap: float) -> list[tuple[int, int]]:
    """Places ``(first word, end)`` that hold enough of a template, apart, in order."""
    ix = index(least_overlap)
    places: dict[int, list] = defaultdict(list)
    own: dict[int, list[int]] = defaultdict(list)
    for i, pair in enumerate(zip(tokens, tokens[1:], strict=False)):
        for t in ix.by_pair.get(pair, ()):
            places[t].append((i, pair))
            if pair in ix.templates[t].own:
                own[t].append(i)
    taken: list[tuple[int, int]] = []

    def free(i: int, j: int) -> bool:
        k = bisect_right(taken, (i, len(tokens)))
        return (k == 0 or taken[k - 1][1] <= i) and (k == len(taken) or j <= taken[k][0])

    def has_own(t: int, i: int, j: int) -> bool:
        k = bisect_left(own[t], i)
        return k < len(own[t]) and own[t][k] < j

    most = {t: len({pair for _, pair in found}) for t, found in places.items()}
    # most pairs first; a word that is taken is in no later place, so texts full of notices are gone through quickly
    for level in range(max(most.values(), default=0), 0, -1):
        tried = []
        for t, found in places.items():
            template = ix.templates[t]
            if template.need <= level <= most[t]:
                runs = ((i, j + 2) for i, j in _runs(found, level))
                tried += [(-level / len(template.pairs), j - i, i, j) for i, j in runs if j - i <= template.room and has_own(t, i, j - 1) and free(i, j)]
        before = len(taken)
        for _, _, i, j in sorted(tried):
            if free(i, j):
                taken.insert(bisect_right(taken, (i, j)), (i, j))
        if len(taken) > before:
            for t in places:
                places[t] = [x for x in places[t] if free(x[0], x[0] + 2)]
                most[t] = len({pair for _, pair in places[t]})
    return taken


def paragraphs(text: str | None) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of lines without a blank one."""
    at = 0
    for m in [*BLANK.finditer(text or ""), None]:
        end = m.start() if m else len(text or "")
        if (text or "")[at:end].strip():
            yield at, end
        at = m.end() if m else end


@dataclass
class Classifier:
    classes: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, tokens: list[str]) -> np.ndarray:
        at = [self.vocabulary[g] for g in sorted(grams(tokens)) if g in self.vocabulary]
        return self.weights[at].sum(0) / np.sqrt(max(1, len(at))) + self.bias

    def probabilities(self, tokens: list[str]) -> np.ndarray:
        z = self.logits(tokens) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def best(self, tokens: list[str], least: float) -> tuple[str, float]:
        p = self.probabilities(tokens)
        k = int(p.argmax())
        return (self.classes[k] if p[k] >= least else UNKNOWN), float(p[k])


Example = tuple[list[str], str]


def put(lead: str, notice: list[str], tail: str) -> list[str]:
    """The words of a notice in its sentence, with the marks of its ends as ``scan`` sets them."""
    before = re.split(STOP, lead)[-1]
    after = re.split(STOP, tail)[0]
    return [BEGIN, *words(before)[-Scan.context :], *notice, *words(after)[: Scan.context], END]


def examples(templates: dict[str, list[str]], corpus: list[list[str]] = (), seed: int = 5, some: int = 12) -> list[Example]:
    """Notices as they are put, and what names no family, from the lists above and sentences of the corpus.

    Of the ways to put a notice, to deny and to mention it, ``some`` each are drawn for every notice.
    """
    rng = np.random.default_rng(seed)
    out: list[Example] = []
    draw = lambda xs: xs[int(rng.integers(len(xs)))]
    for family, texts in templates.items():
        for t in texts:
            w = words(t)
            for at in range(0, max(1, len(w) - 3), PORTION):
                part = w[at : at + PORTION]
                out.append(([BEGIN, *part, END], family))
                out += [(put(draw(LEADS), part, draw(TAILS)), family) for _ in range(some)]
                for _ in range(some // 4):
                    drop = rng.random(len(part)) > 0.1
                    out.append(([BEGIN, *(x for x, keep in zip(part, drop, strict=True) if keep), END], family))
            if len(w) > PORTION:
                out.append(([BEGIN, *w, END], family))
                continue
            out += [(put(draw(DENIALS), w, draw(["", "here", "any more.", "at all"])), UNKNOWN) for _ in range(some)]
            out += [(put(draw(MENTIONS), w, draw(["", *AFTER])), UNKNOWN) for _ in range(some // 2)]
            out += [(put("", w, draw(AFTER)), UNKNOWN) for _ in range(some // 2)]
            if len(w) > 8:
                out.append(([BEGIN, *map(str, rng.permutation(w)), END], UNKNOWN))
    out += [([BEGIN, *words(v), *words(tail), END], UNKNOWN) for v in VAGUE for tail in TAILS]
    out += [([BEGIN, *w, END], UNKNOWN) for w in corpus]
    return out


def fit(rows: list[Example], rounds: int = 150, rate: float = 1.0, ridge: float = 1e-5) -> Classifier:
    """Softmax regression by gradient descent with momentum over n-grams of two examples or more."""
    counted = Counter((tuple(w), c) for w, c in rows)
    held = [sorted(grams(list(w))) for w, _ in counted]
    often = Counter(g for gs in held for g in gs)
    vocabulary = {g: i for i, g in enumerate(sorted(g for g, n in often.items() if n > 1))}
    classes = [*sorted(TEMPLATES), UNKNOWN]
    # sparse rows: the grams of each example end to end; one without any has the empty gram, which weighs nothing
    none = len(vocabulary)
    at = [[vocabulary[g] for g in gs if g in vocabulary] or [none] for gs in held]
    gram, size = np.concatenate([np.array(a) for a in at]), np.array([len(a) for a in at])
    row, first = np.repeat(np.arange(len(at)), size), np.cumsum(size) - size
    value = (1 / np.sqrt(size)).astype(np.float32)[row][:, None]
    by_gram = np.argsort(gram, kind="stable")
    own, begin = np.unique(gram[by_gram], return_index=True)
    y = np.eye(len(classes), dtype=np.float32)[[classes.index(c) for _, c in counted]]
    weight = np.fromiter(counted.values(), np.float32)[:, None] * np.float32(len(classes) / len(rows))
    w, b = np.zeros((none + 1, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        z = np.add.reduceat(w[gram] * value, first) + b
        p = np.exp(z - z.max(1, keepdims=True))
        d = (p / p.sum(1, keepdims=True) - y) * weight
        slope = np.float32(ridge) * w
        slope[own] += np.add.reduceat((d[row] * value)[by_gram], begin)
        slope[none] = 0
        speed_w = np.float32(0.9) * speed_w - np.float32(rate) * slope
        speed_b = np.float32(0.9) * speed_b - np.float32(rate / len(classes)) * d.sum(0)
        w, b = w + speed_w, b + speed_b
    return Classifier(classes, vocabulary, w[:none].astype(np.float64), b.astype(np.float64), 1.0)


def loss(z: np.ndarray, y: np.ndarray, t: float) -> float:
    s = z / t
    return float((np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(s)), y]).mean())


def train(corpus: list[list[str]] = ()) -> Classifier:
    """The model of all phrasings, at the temperature that suits phrasings which a fit has not seen.

    Held out for that: every family's second phrasing and a third of what denies or mentions.
    """
    seen = {f: [t for k, t in enumerate(ts) if k != 1] for f, ts in TEMPLATES.items()}
    unseen = {f: ts[1:2] for f, ts in TEMPLATES.items()}
    first = fit(examples(seen, corpus[::2]))
    other = examples(unseen, corpus[1::2], seed=6)
    z, y = np.array([first.logits(w) for w, _ in other]), np.array([first.classes.index(c) for _, c in other])
    model = fit(examples(TEMPLATES, corpus))
    model.temperature = min((0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0, 1.5, 2.0), key=lambda t: loss(z, y, t))
    return model


Found = tuple[int, int, int, str, float, float, bool]


def scan(text: str | None, model: Classifier, p: Scan = Scan()) -> list[Found]:
    """``(paragraph, start, end, family, probability, overlap, confirmed)`` of all places, in code points."""
    out: list[Found] = []
    if not text or not index(p.least_overlap).some.search(text.lower()):
        return out
    for k, (at, end) in enumerate(paragraphs(text)):
        # places in lower case are places in the text, as lower-casing never makes it shorter
        body = text[at:end].lower()
        if len(body) != end - at:
            body = "".join(c if len(c) == 1 else "?" for c in map(str.lower, text[at:end]))
        if not index(p.least_overlap).some.search(body):
            continue
        spans = [m.span() for m in WORD.finditer(body)]
        tokens = [body[a:b] for a, b in spans]
        stops = [m.start() for m in STOP.finditer(body)]
        for i, j in candidates(tokens, p.least_overlap):
            low, high = max(0, i - p.context), min(len(tokens), j + p.context)
            first, last = bisect_right(stops, spans[i][0]), bisect_right(stops, spans[j - 1][0])
            left = next((x for x in range(i, low, -1) if first and spans[x - 1][0] < stops[first - 1]), low)
            right = next((x for x in range(j, high) if last < len(stops) and spans[x][0] > stops[last]), high)
            whole = [BEGIN] * (left > low or left == 0) + tokens[left:right] + [END] * (right < high or right == len(tokens))
            family, probability = model.best(whole, p.least_probability)
            share = overlap(tokens[i:j], family, p.least_overlap)
            out.append((k, at + spans[i][0], at + spans[j - 1][1], family, probability, share, family != UNKNOWN and share >= p.least_overlap))
    return out


def corpus_sentences(rows: DataFrame, p: Scan) -> list[list[str]]:
    """Up to ``corpus_runs`` short runs of words each from about ``corpus_rows`` documents, none with a notice, in an order that doesn't vary.

    Documents are drawn by a hash of id and text, and runs from all of a text where it is read, so only runs move; the limit bounds them, as
    rows repeated very often are drawn together.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rng, w = np.random.default_rng(mark % 2**63), words(text)
                for at in rng.integers(0, max(1, len(w)), p.corpus_runs).tolist():
                    part = w[at : at + int(rng.integers(3, 20))]
                    if part and not candidates(part, p.least_overlap):
                        out.append(" ".join(part))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["run"])

    mark = F.xxhash64("doc_id", "text")
    share = min(1.0, p.corpus_rows / max(1, rows.count()))
    drawn = rows.where((F.pmod(mark, F.lit(1 << 31)) < int(share * (1 << 31)) + 1) & (F.length("text") > 0)).select("text", mark.alias("mark"))
    found = drawn.mapInArrow(cut, "run string").orderBy(F.xxhash64("run"), "run").limit(2 * p.corpus_rows * p.corpus_runs).toArrow()
    return [run.split(" ") for run in found["run"].to_pylist()]


def licences(docs: DataFrame, p: Scan | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: ``doc_id, n_paragraphs, found``, an array of what ``scan`` tells."""
    p = p or Scan()
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(train(corpus_sentences(rows, p)))
    names = ["paragraph", "start", "end", "family", "probability", "overlap", "confirmed"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
    item = pa.struct(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [[dict(zip(names, f, strict=True)) for f in scan(t, shared.value, p)] for t in texts]
            n = [sum(1 for _ in paragraphs(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(found, pa.list_(item))], names=["doc_id", "n_paragraphs", "found"])

    return rows.mapInArrow(run, "doc_id long, n_paragraphs long, found array<struct<paragraph:int,start:long,end:long,family:string,probability:double,overlap:double,confirmed:boolean>>")
