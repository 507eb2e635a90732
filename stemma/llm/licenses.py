"""Licence scans (operator 1): a trained paragraph classifier, confirmed against templates.

A paragraph goes on over lines until a blank line or a line that ends a sentence, so a notice wrapped at any width is one. A
paragraph of several lines of which little is a licence, or nothing confirmed, is judged line by line. Words are lower-cased runs
of letters, digits and .+-; features are the presence of the n-grams of 1 to 3 words that notices of listed and unlisted licences hold.
A softmax regression on them tells the licence families and an unknown class apart. It is fitted on disturbed copies
of the templates; the unknown class holds notices of licences that are not listed, prose near the subject, the templates'
words in no order, and paragraphs of the corpus: of about `sample_rows` documents, by hash of id and text, the
`sample_paragraphs` of each with the least hashes, of the whole text. The temperature is fitted on notices and
paragraphs that the model at hand has not seen: a third of the wordings of short notices, of the unknown class's templates, of
the copies of longer passages, which are quoted as they stand, and of the paragraphs is held apart in turn. A predicted paragraph is confirmed when it shares enough word pairs with a template of its family, and with none of
another family more.

Defined results: null and empty texts have no paragraphs; a text and a paragraph of any length are read whole; of families of
equal probability the first listed counts; each input row gives one row; a null id stays null; other input columns are not
carried; an empty table gives an empty table, and a model fitted without paragraphs of a corpus.
"""

from __future__ import annotations

import heapq
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm._common import enter, keeps, plain_text, ship

SAMPLE_ROWS, SAMPLE_PARAGRAPHS, LEAST, CONFIRMED, MOSTLY = 400, 20, 0.5, 0.6, 0.34
UNKNOWN = "unknown"
FOLDS = 3

#: Notices of public licences, and passages of their texts, by family. Fixed values.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is distributed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Released under the Apache 2.0 license.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU GPL, version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Licensed under the 2-clause BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "mpl": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "public-domain": [
        "Released into the public domain.",
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0.",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
        "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited.",
    ],
}
#: Prose near the subject that is no licence. Fixed values.
OTHER = [
    "You need a driving license before you rent a car in this country.",
    "The software was released in the spring and distributed to all customers.",
    "The public library is free and open to any person under the age of eighteen.",
    "We thank the author for the permission to visit the works of the foundation.",
    "Version 2.0 of the report was published by the general office in May.",
    "This work is part of a creative project of the commons committee.",
    "The terms of the contract were agreed to in writing by both parties.",
    "Please read the notice at the door and obtain a copy of the form.",
    "His general view of public work was that it must be free of charge.",
    "All conditions of the sale apply, with or without the following list.",
]
#: Notices of licences of no listed family, which are unknown. Fixed values.
UNLISTED = [
    "Distributed under the Boost Software License, Version 1.0.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Released under the Artistic License 2.0.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License.",
    "Licensed under the zlib license.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "Licensed under the Microsoft Public License.",
    "Released under the PostgreSQL License.",
    "Licensed under the Python Software Foundation License, version 2.",
    "SPDX-License-Identifier: BSL-1.0",
    "SPDX-License-Identifier: EPL-2.0",
    "Licensed under the Open Database License, version 1.0.",
    "Released under the Academic Free License 3.0.",
]
#: Ways to say that a licence holds, and names of licences by family. Fixed values.
FRAMES = [
    "Licensed under the {}.",
    "Released under the {}.",
    "This work is licensed under the {}.",
    "This project is distributed under the terms of the {}.",
    "Available under the {}; see the file LICENSE.",
    "Use of this source code is governed by the {}.",
]
NAMES = {
    "mit": ["MIT License", "MIT licence", "Expat MIT License"],
    "apache": ["Apache License, Version 2.0", "Apache 2.0 license", "Apache Software License"],
    "gpl": ["GNU General Public License, version 3", "GNU GPL v2", "GPL version 3 or later"],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v3", "Lesser General Public License"],
    "agpl": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "Affero General Public License"],
    "bsd": ["BSD 3-Clause License", "2-clause BSD license", "New BSD License"],
    "isc": ["ISC License", "ISC licence", "Internet Systems Consortium ISC License"],
    "mpl": ["Mozilla Public License, version 2.0", "MPL 2.0", "Mozilla Public License 1.1"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 3.0 license"],
    "cc-by-sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Attribution-ShareAlike 3.0 license"],
    "cc-by-nc": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Attribution-NonCommercial 3.0 license"],
    "public-domain": ["public domain dedication", "CC0 1.0 public domain dedication", "Unlicense, into the public domain"],
    "proprietary": ["proprietary commercial license", "confidential proprietary license agreement", "commercial end user license agreement"],
    UNKNOWN: ["Boost Software License", "European Union Public Licence", "GNU Free Documentation License", "Eclipse Public License", "Artistic License 2.0", "zlib license", "SIL Open Font License", "Microsoft Public License", "Common Development and Distribution License"],
}
IDENTIFIERS = {"mit": "MIT", "apache": "Apache-2.0", "gpl": "GPL-3.0-only", "lgpl": "LGPL-2.1-or-later", "agpl": "AGPL-3.0-only", "bsd": "BSD-3-Clause", "isc": "ISC", "mpl": "MPL-2.0", "cc-by": "CC-BY-4.0", "cc-by-sa": "CC-BY-SA-4.0", "cc-by-nc": "CC-BY-NC-4.0", "public-domain": "CC0-1.0", "proprietary": "LicenseRef-Proprietary"}
FAMILIES = [*TEMPLATES, UNKNOWN]


def notices(family: str) -> list[tuple[str, int | None]]:
    """The templates of a family, each with the fold that holds it apart whole: short ones by frame, so a fold tests names seen
    in other frames. Passages that are quoted as they stand have none: their disturbed copies are dealt over the folds."""
    own = [(t, None) for t in [*TEMPLATES[family], f"SPDX-License-Identifier: {IDENTIFIERS[family]}"]] if family in TEMPLATES else [(t, i % FOLDS) for i, t in enumerate([*OTHER, *UNLISTED])]
    return own + [(frame.format(name), i % FOLDS) for name in NAMES[family] for i, frame in enumerate(FRAMES)]

_token = re.compile(r"[a-z0-9][a-z0-9.+-]*")
_line = re.compile(r"[^\n]+")
_ends = re.compile(r"[.!?:;][\"')\]]*\s*$")


def tokens(text: str) -> list[str]:
    return [t.rstrip(".-") for t in _token.findall(text.lower())]


def _pairs(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


class _Grams:
    """The templates' n-grams, numbered. Words have numbers from 1; n-grams are looked up by their words'."""

    def __init__(self) -> None:
        texts = [tokens(t) for family in FAMILIES for t, _ in notices(family) if t not in OTHER]
        self.word = {w: i + 1 for i, w in enumerate(sorted({w for t in texts for w in t}))}
        self.base = len(self.word) + 1
        keys = {k for t in texts for k in self.keys(np.array([self.word[w] for w in t]))[0].tolist()}
        self.sorted = np.array(sorted(keys), dtype=np.int64)
        self.raw: dict[str, int] = {}
        self.pairs = {f: [_pairs(tokens(t)) for t, _ in notices(f)] for f in TEMPLATES}

    def keys(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, position) of the n-grams that consist of known words."""
        ids = ids.astype(np.int64)
        out, at = [ids], [np.arange(len(ids))]
        for n in (2, 3):
            if len(ids) >= n:
                parts = [ids[i : len(ids) - n + 1 + i] for i in range(n)]
                known = np.all([p > 0 for p in parts], axis=0)
                key = np.zeros(known.sum(), np.int64)
                for p in parts:
                    key = key * self.base + p[known]
                out.append(key)
                at.append(np.flatnonzero(known))
        key, at = np.concatenate(out), np.concatenate(at)
        return key[key > 0], at[key > 0]

    def features(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(feature, which of the keys are one)."""
        at = np.searchsorted(self.sorted, key)
        at[at == len(self.sorted)] = 0
        return at, self.sorted[at] == key

    def ids(self, words: list[str]) -> list[int]:
        """Numbers of blank-separated words; one may hold several tokens, then 0 ends it on each side."""
        out = []
        for w in words:
            own = self.raw.get(w)
            if own is None:
                own = tuple(self.word.get(t, 0) for t in tokens(w)) or None
                if len(self.raw) > 400_000:
                    self.raw.clear()
                if len(w) <= 64:
                    self.raw[w] = own or ()
                own = own or ()
            out += own
        return out


_grams: list[_Grams] = []
keeps("licenses", _grams.clear)


def grams() -> _Grams:
    """One for each worker process."""
    if not _grams:
        _grams.append(_Grams())
    return _grams[0]


def rows_of(lines: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(line, feature) of the features of numbered lines, each once."""
    g = grams()
    flat, row = [], []
    for i, ids in enumerate(lines):
        flat += [*ids, 0, 0]
        row += [i] * (len(ids) + 2)
    if not flat:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, at = g.keys(np.array(flat))
    feature, known = g.features(key)
    pair = np.unique(np.array(row, dtype=np.int64)[at[known]] * len(g.sorted) + feature[known])
    return pair // len(g.sorted), pair % len(g.sorted)


def shared(text: str, family: str) -> float:
    """The largest share of the paragraph's word pairs that one of the family's templates has too."""
    own = _pairs(tokens(text))
    return max((len(own & pairs) for pairs in grams().pairs.get(family, ())), default=0) / max(len(own), 1)


def similarity(text: str, family: str) -> float:
    """The larger share of word pairs that the paragraph and one of the family's templates have in common."""
    own, best = _pairs(tokens(text)), 0.0
    for pairs in grams().pairs.get(family, ()):
        both = len(own & pairs)
        part = both / len(own) if len(own) >= 6 else 0.0
        best = max(best, both / len(pairs), part)
    return best


def paragraphs(text: str) -> list[list[tuple[int, int]]]:
    """The lines (start, end) of each paragraph that has a word."""
    out, open_, at = [], False, -1
    for m in _line.finditer(text):
        line = m[0]
        if not line.strip():
            open_ = False
            continue
        if open_ and m.start() == at + 1:
            out[-1].append(m.span())
        else:
            out.append([m.span()])
        open_, at = not _ends.search(line[-40:]), m.end()
    return out


@dataclass
class Model:
    weight: np.ndarray  # feature x family
    bias: np.ndarray
    temperature: float
    least: float

    def logits(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """row must be sorted, as rows_of() gives it."""
        z = np.tile(self.bias, (n, 1))
        if len(row):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            size = np.diff(np.append(first, len(row)))
            z[row[first]] += np.add.reduceat(self.weight[feature], first, axis=0) / np.sqrt(size)[:, None]
        return z

    def probabilities(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return _softmax(self.logits(row, feature, n) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _disturbed(rng: random.Random, text: str, noise: list[str]) -> str:
    words = text.split()
    if len(words) > 6 and rng.random() < 0.5:
        at = rng.randrange(len(words) - 5)
        words = words[at : at + rng.randrange(6, len(words) + 1)]
    words = [re.sub(r"\d+(\.\d+)?", lambda m: rng.choice([m[0], "1.0", "2.0", "3", "3.0", "4.0"]), w) for w in words if rng.random() > 0.06]
    if rng.random() < 0.3:
        words = ["Copyright", str(rng.randrange(1990, 2030)), *rng.sample(noise, min(2, len(noise))), *words]
    for _ in range(rng.choice([0, 0, 1, 3, 8])):
        if noise:
            words.insert(rng.choice([0, len(words)]), rng.choice(noise))
    return rng.choice([str, str.upper, str.lower])(" ".join(words))


@dataclass
class Rows:
    """Training rows: features in order of rows, the class, and the fold in which a row is held apart."""

    row: np.ndarray
    feature: np.ndarray
    y: np.ndarray
    fold: np.ndarray


def training_rows(sample: list[tuple[list[int], list[str]]], copies: int = 12, without: frozenset[str] = frozenset()) -> Rows:
    """sample: (features, some words) of paragraphs of the corpus. without: families left out whole."""
    rng = random.Random(4)
    noise = sorted({w for _, words in sample for w in words})
    texts = []  # (text, class, fold): disturbed copies of a template share its fold
    for c, family in enumerate(FAMILIES):
        if family not in without:
            own = notices(family)
            n = -(-copies * 20 // len(own))
            texts += [(t if j == n else _disturbed(rng, t, noise), c, j % FOLDS if f is None else f) for t, f in own for j in range(n + 1)]
    soup = sorted(grams().word)  # the templates' words in no order say nothing, nor do those of one notice
    bags = [t.split() for family in TEMPLATES if family not in without for t, _ in notices(family)]
    for i in range(2500):
        some = soup if i % 2 else rng.choice(bags)
        texts.append((" ".join(rng.choice(some if rng.random() < 0.5 or not noise else noise) for _ in range(rng.randrange(3, 40))), len(TEMPLATES), i % FOLDS))
    row, feature = rows_of([grams().ids(t.split()) for t, _, _ in texts])
    more = [np.array(sorted(f), dtype=np.int64) for f, _ in sample]
    row = np.concatenate([row, np.repeat(np.arange(len(more)) + len(texts), [len(f) for f in more]).astype(np.int64)])
    feature = np.concatenate([feature, *more]).astype(np.int64)
    y = np.array([c for _, c, _ in texts] + [len(TEMPLATES)] * len(more))
    fold = np.array([f for _, _, f in texts] + [i % FOLDS for i in range(len(more))])
    return Rows(row, feature, y, fold)


def fit_softmax(rows: Rows, use: np.ndarray, rounds: int = 120) -> Model:
    """Accelerated gradient steps on the rows of `use`; every class weighs alike."""
    n, m, c = len(rows.y), len(grams().sorted), len(FAMILIES)
    weigh = np.where(use, 1 / np.maximum(np.bincount(rows.y[use], minlength=c), 1)[rows.y], 0.0)
    weigh /= weigh.sum()
    mine = use[rows.row]
    row, feature = rows.row[mine], rows.feature[mine]
    value = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))[row]
    by = np.argsort(feature, kind="stable")
    first = np.flatnonzero(np.diff(feature[by], prepend=-1))
    goal = np.eye(c)[rows.y]
    model, w0, b0 = Model(np.zeros((m, c)), np.zeros(c), 1.0, LEAST), np.zeros((m, c)), np.zeros(c)
    for i in range(rounds):
        ahead = Model(model.weight + (model.weight - w0) * i / (i + 3), model.bias + (model.bias - b0) * i / (i + 3), 1.0, LEAST)
        g = (_softmax(ahead.logits(row, feature, n)) - goal) * weigh[:, None]
        step = 1e-6 * ahead.weight
        if len(row):
            step[feature[by[first]]] += np.add.reduceat((g[row] * value[:, None])[by], first, axis=0)
        w0, b0 = model.weight, model.bias
        model = Model(ahead.weight - 20.0 * step, ahead.bias - 5.0 * g.sum(0), 1.0, LEAST)
    return model


def fit(sample: list[tuple[list[int], list[str]]], least: float = LEAST, without: frozenset[str] = frozenset()) -> Model:
    """The model of all rows, with the temperature that suits rows of templates and paragraphs not seen."""
    rows = training_rows(sample, without=without)
    z = np.zeros((len(rows.y), len(FAMILIES)))
    for f in range(FOLDS):
        apart = rows.fold == f
        z[apart] = fit_softmax(rows, ~apart).logits(rows.row, rows.feature, len(rows.y))[apart]
    weigh = 1 / np.maximum(np.bincount(rows.y, minlength=len(FAMILIES)), 1)[rows.y]

    def loss(t: float) -> float:
        own = z / t
        top = own.max(1)
        return float(np.average(np.log(np.exp(own - top[:, None]).sum(1)) + top - own[np.arange(len(own)), rows.y], weights=weigh))

    model = fit_softmax(rows, np.ones(len(rows.y), dtype=bool))
    model.temperature, model.least = float(min(np.geomspace(0.1, 20, 121), key=loss)), least
    return model


def _examples(most: int):
    """Texts -> the features and some words of the paragraphs with the least hashes that are not close to a template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("licenses")
        for batch in batches:
            features, noise = [], []
            for text in batch.column("t").to_pylist():
                whole = (text[own[0][0] : own[-1][1]] for own in paragraphs(text))
                for _, p in heapq.nsmallest(most, ((zlib.crc32(x.encode("utf-8", "surrogatepass")), x) for x in whole)):
                    if not any(grams().ids(p.split())) or max(similarity(p, f) for f in TEMPLATES) < 0.34:
                        features.append(rows_of([grams().ids(p.split())])[1].tolist())
                        words = sorted({w for w in p.split() if len(w) <= 32}, key=lambda w: zlib.crc32(w.encode("utf-8", "surrogatepass")))
                        noise.append(words[:3])
            yield pa.RecordBatch.from_arrays([pa.array(features, pa.list_(pa.int32())), pa.array(noise, pa.list_(pa.string()))], ["features", "noise"])

    return run


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, sample_paragraphs: int = SAMPLE_PARAGRAPHS, least: float = LEAST) -> Model:
    """Reads about `sample_rows` documents, whole, for examples of the unknown class."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("k"), plain_text(text_col).alias("t"))
    share = min(1.0, sample_rows / max(rows.count(), 1))
    some = rows.select("t", F.xxhash64("k", "t").alias("h")).where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).dropDuplicates(["h"])
    found = some.select("t").mapInArrow(_examples(sample_paragraphs), "features array<int>, noise array<string>").collect()
    return fit(sorted((list(r.features), list(r.noise)) for r in found), least)


_found = "array<struct<paragraph:int,start:int,end:int,family:string,probability:double,similarity:double,confirmed:boolean>>"


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", confirm: float = CONFIRMED) -> DataFrame:
    """(id_col, n_paragraphs int, licences): the paragraphs, or lines of one, that the model gives to a family."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def judged(texts: list[str], units: list[tuple[int, int, int, int]]) -> list[dict | None]:
        """units (text, paragraph, start, end) -> what each is found to be."""
        g = grams()
        ids = [g.ids(texts[i][start:end].split()) for i, _, start, end in units]
        some = [j for j, x in enumerate(ids) if any(x)]
        out: list[dict | None] = [None] * len(units)
        p = model.probabilities(*rows_of([ids[j] for j in some]), len(some)) if some else np.zeros((0, len(FAMILIES)))
        for at in np.flatnonzero((p.argmax(1) < len(TEMPLATES)) & (p.max(1, initial=0) > model.least)).tolist():
            i, no, start, end = units[some[at]]
            family = FAMILIES[int(p[at].argmax())]
            alike = {f: similarity(texts[i][start:end], f) for f in TEMPLATES}
            sure = alike[family] >= confirm and alike[family] == max(alike.values())
            out[some[at]] = {"paragraph": no, "start": start, "end": end, "family": family, "probability": float(p[at].max()), "similarity": alike[family], "confirmed": sure}
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("licenses")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("t").to_pylist()
                own = [paragraphs(t) for t in texts]
                whole = [(i, no, lines[0][0], lines[-1][1]) for i, ps in enumerate(own) for no, lines in enumerate(ps)]
                first = judged(texts, whole)
                sure = [bool(x) and x["confirmed"] and shared(texts[u[0]][u[2] : u[3]], x["family"]) >= MOSTLY for u, x in zip(whole, first, strict=True)]
                single = [(i, no, *line) for (i, no, _, _), done in zip(whole, sure, strict=True) if len(own[i][no]) > 1 and not done for line in own[i][no]]
                out: list[list[dict]] = [[] for _ in texts]
                split = {(i, no) for i, no, _, _ in single}
                kept = [(u, x) for u, x in zip(whole, first, strict=True) if x and u[:2] not in split]
                later = [(u, x) for u, x in zip(single, judged(texts, single), strict=True) if x]
                lined = {u[:2] for u, _ in later}
                kept += [(u, x) for u, x in zip(whole, first, strict=True) if x and u[:2] in split and u[:2] not in lined]
                for u, x in sorted([*kept, *later], key=lambda r: r[0]):
                    out[u[0]].append(x)
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array([len(ps) for ps in own], pa.int32()), pa.array(out, _arrow)], ["k", "n_paragraphs", "licences"])

    rows = docs.select(F.col(id_col).alias("k"), plain_text(text_col).alias("t"))
    return rows.mapInArrow(run, f"k {kind}, n_paragraphs int, licences {_found}").withColumnRenamed("k", id_col)


_arrow = pa.list_(pa.struct([("paragraph", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())]))
