"""Licence families of paragraphs by a trained classifier over hashed word n-grams.

A multinomial logistic regression over words, word pairs and word triples is
fitted to statements made from the templates below and to other prose; its
probabilities are calibrated by a temperature on held-out statements, and the
class ``unknown`` takes what is no licence. A predicted family counts only if a
template of that family is found in the paragraph to a large part. Beside the
lines, every stretch of words that holds a large part of a template is
classified, across line breaks and inside long lines.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import tidy
from millrace.llm.grid import GOLDEN, Grid, U, slices, windows, words

# Usual statements of licence families, in plain words.
TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License", "distributed under the terms of the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0", "Apache License 2.0", "Apache-2.0 licensed", "Released under the Apache 2.0 license", "license: Apache-2.0"],
    "mit": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "This project is licensed under the terms of the MIT license", "SPDX-License-Identifier: MIT", "MIT License", "This project is MIT licensed", "license: MIT", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "This is free software licensed under the GPL version 2 or later", "SPDX-License-Identifier: GPL-3.0-or-later", "GPLv3", "licensed under the GPLv3", "GNU GPL version 3", "license: GPL-3.0"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-only"],
    "agpl": ["This work is licensed under the GNU Affero General Public License, version 3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Released under the BSD 3-Clause License", "Use of this source code is governed by a BSD-style license", "SPDX-License-Identifier: BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "BSD 3-Clause License", "license: BSD-3-Clause"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License 2.0", "license: MPL-2.0"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Text is available under the Creative Commons Attribution-ShareAlike License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "public-domain": ["This is free and unencumbered software released into the public domain", "To the extent possible under law, the author has waived all copyright and related rights to this work", "Released under CC0 1.0 Universal", "Unlicense", "This work is in the public domain", "released into the public domain", "The Unlicense"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License", "ISC License", "license: ISC"],
    "boost": ["Distributed under the Boost Software License, Version 1.0", "Boost Software License", "SPDX-License-Identifier: BSL-1.0"],
    "epl": ["made available under the terms of the Eclipse Public License v2.0", "Eclipse Public License", "SPDX-License-Identifier: EPL-2.0"],
    "eupl": ["Licensed under the EUPL, Version 1.2", "European Union Public Licence", "SPDX-License-Identifier: EUPL-1.2"],
    "proprietary": ["All rights reserved", "All rights reserved. No part of this publication may be reproduced", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited"],
}
# Prose that has licence words without being a licence.
OTHER = [
    "the city council will license new taxis next year", "her driving license had expired", "the general public was invited to the opening of the free library",
    "software for the new version will be released in spring", "permission was granted to build the house", "the apache helicopter landed near the village",
    "students at mit won the prize", "mit released a report on its new license", "the bars lost their license last year", "a boost for the software industry", "the eclipse was public news",
    "the union of european states published a licence plan", "the domain was public for years", "copyright law protects authors of original works", "the work is distributed among several teams", "he reserved all the rooms on the second floor",
    "the foundation published a report on creative work", "use this form to modify the terms of your order", "a person obtaining a copy of the letter kept it",
    "the source of the river is in the mountains", "all members have equal rights and duties", "in compliance with the rules of the house", "the library lends books free of charge",
    "the commons debated the public accounts", "an attribution of the painting to the master is doubtful", "the warranty of the car covers two years",
]
FAMILIES = ["unknown", *TEMPLATES]
BITS, ORDERS = 15, (1, 2, 3)
#: Statements that are made to fit the classifier to; a bound of the training alone.
SAMPLES = 6000
LEAST_PROBABILITY, LEAST_MATCH = 0.5, 0.75


def features(grid: Grid) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order of n-grams, their slots and the first of each row."""
    out = []
    for n in ORDERS:
        win = windows(grid, n)
        with np.errstate(over="ignore"):
            out.append((((win.hashes + U(n) * GOLDEN) >> U(64 - BITS)).astype(np.int64), win.first))
    return out


def _statements(rng: np.random.Generator, n: int) -> tuple[list[str], np.ndarray]:
    syllables = np.asarray("the on er an re ti th en at or es is it nd ha of to in ou ea con ver lo ra mi sta".split())
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 5)))
    prose = lambda k: [word() for _ in range(k)]
    licence_words = sorted({w for v in TEMPLATES.values() for x in v for w in x.split()})
    texts, labels = [], []
    for _ in range(n):
        label = int(rng.integers(0, len(FAMILIES))) if rng.random() < 0.6 else 0
        if label:
            own = TEMPLATES[FAMILIES[label]]
            body = own[rng.integers(0, len(own))].split()
            body = [w for w in body if rng.random() > 0.04]
            body = [re.sub(r"\d", lambda _: str(rng.integers(1, 5)), w) for w in body]
        else:
            kind = rng.random()
            if kind < 0.4:
                body = prose(int(rng.integers(1, 40)))
            elif kind < 0.7:
                body = OTHER[rng.integers(0, len(OTHER))].split()
            else:
                body = [w for _ in range(int(rng.integers(1, 6))) for w in [rng.choice(licence_words), *prose(int(rng.integers(1, 5)))]]
        around = rng.random()
        body = prose(int(rng.integers(0, 12)) if around < 0.4 else 0) + body + prose(int(rng.integers(0, 12)) if around > 0.7 else 0)
        texts.append(" ".join(body))
        labels.append(label)
    return texts, np.asarray(labels)


def _scores(weight: np.ndarray, bias: np.ndarray, grid: Grid) -> np.ndarray:
    out = np.tile(bias, (len(grid.first) - 1, 1))
    for slot, first in features(grid):
        some = np.flatnonzero(np.diff(first))
        if len(some):
            out[some] += np.add.reduceat(weight[slot], first[some], axis=0)
    return out


def probabilities(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@lru_cache(maxsize=1)
def model(samples: int = SAMPLES, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, bias and temperature, fitted by mini-batch gradient descent (Adagrad)."""
    rng = np.random.default_rng(seed)
    texts, labels = _statements(rng, samples)
    held = samples // 5
    weight, bias = np.zeros((1 << BITS, len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    seen, seen_bias = np.full_like(weight, 1e-3), np.full_like(bias, 1e-3)
    for _ in range(6):
        order = rng.permutation(np.arange(held, samples))
        for k in range(0, len(order), 64):
            own = order[k : k + 64]
            grid = words(pa.array([texts[i] for i in own]), punctuation=True, fold=True)
            error = probabilities(_scores(weight, bias, grid)).astype(np.float32)
            error[np.arange(len(own)), labels[own]] -= 1
            for slot, first in features(grid):
                step = np.repeat(error, np.diff(first), axis=0)
                np.add.at(seen, slot, step**2)
                np.add.at(weight, slot, -0.1 * step / np.sqrt(seen[slot]))
            seen_bias += (error**2).sum(0)
            bias -= 0.1 * error.sum(0) / np.sqrt(seen_bias)
    scores = _scores(weight, bias, words(pa.array(texts[:held]), punctuation=True, fold=True))
    loss = lambda t: -np.log(probabilities(scores / t)[np.arange(held), labels[:held]] + 1e-12).mean()
    return weight, bias, float(min(np.geomspace(0.25, 8, 40), key=loss))


def _pairs(grid: Grid) -> Grid:
    return windows(grid, 2)


def _template_pairs() -> dict[str, list[np.ndarray]]:
    return {f: [np.unique(_pairs(words(pa.array([re.sub(r"[0-9.]+", " ", x)]), punctuation=True, fold=True)).hashes) for x in v] for f, v in TEMPLATES.items()}


#: A word as in the pairs, which have no digits; a stretch of them has at most so many words for each of its template.
_WORD = re.compile(rb"[^\x09-\x0d\x20-\x40\x5b-\x60\x7b-\x7e]+")
SPREAD = 2


def _take(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Adds a to b to the ordered stretches unless it lies on one of them."""
    k = bisect(taken, (a, b))
    if (k and taken[k - 1][1] >= a) or (k < len(taken) and taken[k][0] <= b):
        return False
    taken.insert(k, (a, b))
    return True


def _best_stretches(place: np.ndarray, pair: np.ndarray, least: float, most: int) -> list[tuple[int, int]]:
    """First and last pair of the stretches of up to ``most`` pairs with ``least`` different ones, the fullest first, none on another."""
    found, j = [], 0
    for i in range(len(place)):
        j = max(j, i)
        while j < len(place) and place[j] - place[i] < most:
            j += 1
        own = pair[i:j]
        first = np.unique(own, return_index=True)[1]
        if len(first) >= least:
            last = i + int(first.max())
            found.append((-len(first), int(place[last] - place[i]), int(place[i]), int(place[last])))
    out: list[tuple[int, int]] = []
    for _, _, a, b in sorted(found):
        _take(out, a, b)
    return out


class Stretches:
    """Finds the stretches of words that hold a large part of a template, wherever lines break."""

    def __init__(self, templates: dict[str, list[np.ndarray]]):
        flat = [x for v in templates.values() for x in v]
        self.known = np.unique(np.concatenate(flat))
        self.holds = np.stack([np.isin(self.known, x) for x in flat], 1)
        self.sizes = self.holds.sum(0)

    def of(self, texts: pa.Array) -> Iterator[tuple[int, bytes, int, int]]:
        """(row, text, start, end): each stretch in bytes of its text, to the white space around it."""
        pairs = _pairs(words(pc.replace_substring_regex(texts, "[0-9]", " "), punctuation=True, fold=True))
        at = np.minimum(np.searchsorted(self.known, pairs.hashes), len(self.known) - 1)
        hit = np.flatnonzero(self.known[at] == pairs.hashes)
        row = np.searchsorted(pairs.first, hit, side="right") - 1
        different = np.unique(row * np.int64(len(self.known)) + at[hit])
        of, pair = different // len(self.known), different % len(self.known)
        for r in np.unique(of).tolist():
            whole = self.holds[pair[of == r]].sum(0)
            enough = np.flatnonzero(whole >= LEAST_MATCH * self.sizes)
            if not len(enough):
                continue
            own = hit[row == r]
            text = texts[r].as_py().encode()
            spans = [m.span() for m in _WORD.finditer(text)]
            for t in enough.tolist():
                mine = own[self.holds[at[own], t]]
                for a, b in _best_stretches(mine - pairs.first[r], at[mine], LEAST_MATCH * self.sizes[t], SPREAD * (int(self.sizes[t]) + 1)):
                    start, end = spans[a][0], spans[min(b + 1, len(spans) - 1)][1]
                    while start > 0 and text[start - 1 : start] not in b" \t\n\x0b\x0c\r":
                        start -= 1
                    while end < len(text) and text[end : end + 1] not in b" \t\n\x0b\x0c\r":
                        end += 1
                    yield r, text, start, end


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias, temperature = shared.value
        templates = _template_pairs()
        stretches = Stretches(templates)

        def matched(families: list[int], said: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            """The share and the number of the pairs of each text's best template of its family."""
            pairs = _pairs(words(pc.replace_substring_regex(said, "[0-9.]+", " "), punctuation=True, fold=True))
            of = np.repeat(np.arange(len(said)), np.diff(pairs.first))
            kinds, share, n = np.asarray(families), np.zeros(len(said)), np.zeros(len(said), np.int64)
            for kind in np.unique(kinds).tolist():
                mine = kinds[of] == kind
                text, hashes = of[mine], pairs.hashes[mine]
                for template in templates[FAMILIES[kind]]:
                    at = np.minimum(np.searchsorted(template, hashes), len(template) - 1)
                    hit = template[at] == hashes
                    own = np.bincount(np.unique(text[hit] * np.int64(len(template)) + at[hit]) // len(template), minlength=len(said))
                    better = (own / len(template) > share) | ((own / len(template) == share) & (own > n))
                    share, n = np.where(better, own / len(template), share), np.where(better, own, n)
            return share, n

        def merge(out: list[list[dict]], found: list, said: list[str], p: np.ndarray) -> None:
            """Adds the confirmed stretches whose family no line or fuller stretch at their place has."""
            held = []
            sure = np.flatnonzero((p.argmax(1) > 0) & (p.max(1) >= LEAST_PROBABILITY))
            if len(sure):
                share, n = matched(p[sure].argmax(1).tolist(), pa.array([said[k] for k in sure], pa.string()))
                for k, one, pairs in zip(sure.tolist(), share.tolist(), n.tolist(), strict=True):
                    if one >= LEAST_MATCH:
                        r, text, a, b = found[k]
                        held.append((r, -pairs, -float(p[k].max()), a, b, FAMILIES[p[k].argmax()], one, text))
            taken: dict[int, list[tuple[int, int]]] = {}
            lines = [{(x["paragraph"], x["family"]) for x in own} for own in out]
            breaks: dict[int, np.ndarray] = {}
            for r, _, probability, a, b, family, share, text in sorted(held, key=lambda x: x[:5]):
                if not _take(taken.setdefault(r, []), a, b - 1):
                    continue
                if r not in breaks:
                    breaks[r] = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
                line, last = np.searchsorted(breaks[r], [a, b]).tolist()
                if not any((k, family) in lines[r] for k in range(line, last + 1)):
                    out[r].append({"paragraph": line, "family": family, "probability": -probability, "match": share})
            for r in taken:
                out[r].sort(key=lambda x: x["paragraph"])

        for batch in batches:
            for at, texts in slices(batch.column(1)):
                lines = pc.split_pattern(texts.fill_null(""), "\n")
                doc = np.repeat(np.arange(len(texts)), np.diff(lines.offsets.to_numpy()))
                flat = lines.values
                scores = _scores(weight, bias, words(flat, punctuation=True, fold=True))
                p = probabilities(scores / temperature)
                best = p.argmax(1)
                out: list[list[dict]] = [[] for _ in range(len(texts))]
                first = lines.offsets.to_numpy()
                sure = np.flatnonzero((best > 0) & (p.max(1) >= LEAST_PROBABILITY))
                if len(sure):
                    shares, _ = matched(best[sure].tolist(), flat.take(pa.array(sure)))
                    for k, share in zip(sure.tolist(), shares.tolist(), strict=True):
                        if share >= LEAST_MATCH:
                            out[doc[k]].append({"paragraph": int(k - first[doc[k]]), "family": FAMILIES[best[k]], "probability": float(p[k].max()), "match": share})
                found = list(stretches.of(texts.fill_null("")))
                if found:
                    said = [text[a:b].decode(errors="replace") for _, text, a, b in found]
                    p = probabilities(_scores(weight, bias, words(pa.array(said), punctuation=True, fold=True)) / temperature)
                    merge(out, found, said, p)
                kind = pa.list_(pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("match", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(out, kind)], names=["doc_id", "found"])

    return tidy(run)


def licences(docs: DataFrame) -> DataFrame:
    """(doc_id, found) of each row of ``docs`` (doc_id, text); found lists the licence paragraphs.

    A paragraph is a line, or a stretch of words with a large part of a
    template, which may be wrapped or lie in a long line; found has the number
    from 0 of its first line, the family, the calibrated probability and the
    share of the best template's word pairs in it. A null or empty text, like one without a confirmed family, has an empty
    list. Repeated rows stay; other columns of docs are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(shared), "doc_id long, found array<struct<paragraph:long,family:string,probability:double,match:double>>")
