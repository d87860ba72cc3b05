"""Licence scan: a trained paragraph classifier, confirmed by templates.

A paragraph is a line with at least one word.  Its features are the word
1-, 2- and 3-grams of the classifier's vocabulary (those of the templates), so
a paragraph without any cue word (every template has one) is unknown at once.  One-against-rest logistic regressions, one per licence family, are
trained on variants of the templates (holders, years, lead-ins, lost words)
against the corpus's own paragraphs and other families; each is calibrated by
a line through its held-out scores (Platt), and a paragraph belongs to the
unknown class unless one family's calibrated probability reaches
``min_probability``.  A prediction is confirmed when enough of the word
bigrams of one of the family's templates occur in the paragraph.

Negative paragraphs come from at most ``max_documents`` documents (those with
the smallest id hashes); the model is broadcast, its size bounded by the
templates.  Whole texts are scanned.

Defined results: a null or empty text has no paragraphs and no licence.  Every
row is scanned on its own, repeated rows and null ids included.  If two
families tie, the smaller name wins.  With no documents to draw negatives from
only other families are negatives.  Only ``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rollbook.llm.common import small_batches, text_of

# Notices by which works commonly name their licence.
TEMPLATES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
             "This work is licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL-3.0 license."],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
               "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0", "This project is released under the Apache 2.0 license."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Released under the BSD license."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Licensed under the Creative Commons Attribution license."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "Shared under CC BY-NC-SA 4.0, no commercial use."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under CC0 1.0 Universal.", "Released into the public domain under CC0."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "You should have received a copy of the GNU General Public License along with this program.", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GPL version 2."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "This work is licensed under the GNU Lesser General Public License, version 2.1.", "Released under the LGPL."],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "Licensed under the MIT license.", "SPDX-License-Identifier: MIT", "This project is licensed under the terms of the MIT license."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License 2.0."],
    "proprietary": ["All rights reserved.", "Unauthorized copying of this file, via any medium is strictly prohibited.", "Proprietary and confidential."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
}
# Every template holds one of these; a paragraph without any is unknown.
CUES = ["licen[cs]e", "rights reserved", "gpl", "cc0", r"cc by", "public domain", "permission", "permitted", "prohibited", "confidential", "all copyright", "mpl", "free software"]
LEAD_INS = ["", "", "note:", "copyright (c) 2019 the authors.", "license:", "this text is", "the code and its documentation are", "(c) 2021 by the contributors,", "see below."]

_WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def grams(words: list[str]) -> list[tuple[str, ...]]:
    return [*zip(words), *zip(words, words[1:]), *zip(words, words[1:], words[2:])]


class Scanner:
    """A trained model, as plain data: ``vocabulary`` (gram to column),
    ``weights`` (columns x families), ``constants``, ``scales`` and
    ``shifts`` (calibration)."""

    def __init__(self, model: dict):
        self.__dict__.update(model)
        self.families = sorted(TEMPLATES)
        self.bigrams = {f: [set(zip(w, w[1:])) for t in ts if (w := words_of(t))] for f, ts in TEMPLATES.items()}
        self.cue = re.compile("|".join(CUES), re.IGNORECASE)

    def scores(self, words: list[str]) -> np.ndarray:
        at = {c for g in grams(words) if (c := self.vocabulary.get(g)) is not None}
        return self.constants + self.weights[sorted(at)].sum(0) / np.sqrt(max(len(at), 1))

    def probabilities(self, words: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scales * self.scores(words) + self.shifts, -50, 50)))

    def similarity(self, words: list[str], family: str) -> float:
        """The largest share of a template's bigrams that the paragraph has."""
        own = set(zip(words, words[1:]))
        return max(len(own & t) / len(t) for t in self.bigrams[family])

    def scan(self, text: str, min_probability: float, min_similarity: float) -> list[tuple[int, int, int, str, float, float]]:
        """(paragraph, start, end, family, probability, similarity) of every
        paragraph that is not of the unknown class."""
        if not self.cue.search(text):
            return []
        out, start, number = [], 0, 0
        for line in text.split("\n"):
            end = start + len(line)
            if line.strip():
                number += 1
                if self.cue.search(line):
                    w = words_of(line)
                    p = self.probabilities(w)
                    best = int(p.argmax())
                    if p[best] >= min_probability:
                        family = self.families[best]
                        out.append((number, start, end, family, float(p[best]), self.similarity(w, family)))
            start = end + 1
        return out


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """One-against-rest weights for 0/1 targets ``y`` (rows x families)."""
    w, c = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
    m, s = np.zeros_like(w), np.zeros_like(w)
    weight = np.where(y == 1, len(y) / np.maximum(y.sum(0), 1), 1.0) / len(y)
    for step in range(1, rounds + 1):
        d = (1 / (1 + np.exp(-np.clip(x @ w + c, -50, 50))) - y) * weight
        g = x.T @ d + decay * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)
        c -= 0.5 * d.sum(0)
    return w, c


def train(negatives: list[str], seed: int = 8, variants: int = 30, rounds: int = 150) -> dict:
    """The model for ``Scanner``, from template variants and the corpus's own
    paragraphs (lines without a cue word)."""
    random = np.random.default_rng(seed)
    families = sorted(TEMPLATES)
    vocabulary: dict = {}
    for f in families:
        for t in TEMPLATES[f]:
            for g in grams(words_of(t)):
                vocabulary.setdefault(g, len(vocabulary))
    names = {w for ts in TEMPLATES.values() for t in ts for w in words_of(t)}
    rows, targets = [], []
    for i, f in enumerate(families):
        for t in TEMPLATES[f]:
            for _ in range(variants):
                w = words_of(str(random.choice(LEAD_INS)) + " " + t)
                keep = random.random(len(w)) >= random.choice([0, 0, 0.1])
                w = [x for x, k in zip(w, keep) if k]
                if random.random() < 0.3 and negatives:
                    w += words_of(negatives[random.integers(len(negatives))])[:12]
                rows.append(w)
                targets.append(i)
    for n in negatives:
        rows.append(words_of(n))
        targets.append(-1)
    # Prose with single words of the templates is no licence.
    pool = sorted(names)
    for _ in range(len(families) * variants * 3):
        rows.append([str(x) for x in random.choice(pool, random.integers(1, 8))] + (words_of(negatives[random.integers(len(negatives))])[:20] if negatives else []))
        targets.append(-1)
    x = np.zeros((len(rows), len(vocabulary)), dtype=np.float32)
    for r, w in enumerate(rows):
        at = sorted({c for g in grams(w) if (c := vocabulary.get(g)) is not None})
        x[r, at] = 1 / np.sqrt(max(len(at), 1))
    y = (np.array(targets)[:, None] == np.arange(len(families))).astype(float)
    fit = random.random(len(rows)) < 0.75
    w, c = _logistic(x[fit], y[fit], rounds, 1e-4)
    # Calibration: a logistic line through each family's held-out scores.
    scales, shifts = np.ones(len(families)), np.zeros(len(families))
    held = x[~fit] @ w + c
    for i in range(len(families)):
        z, t = held[:, i], y[~fit][:, i]
        if 0 < t.sum() < len(t):
            a, b = 1.0, 0.0
            for _ in range(200):
                d = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50))) - t
                a, b = a - 0.1 * ((d * z).mean() + 0.001 * (a - 1)), b - 0.1 * d.mean()
            scales[i], shifts[i] = max(a, 0.1), b
    return {"vocabulary": vocabulary, "weights": w, "constants": c, "scales": scales, "shifts": shifts}


def fit(docs: DataFrame, max_documents: int = 300, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Train with the first cue-free paragraph of at most ``max_documents``
    documents as negatives."""
    plain = docs.select(F.col(id_col).alias("id")).where("id is not null").orderBy(F.xxhash64("id"), "id").limit(max_documents).distinct()
    lines = (docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(plain), "id")
             .select("id", F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)).between(1, 2000) & ~F.lower(x).rlike("|".join(CUES))).alias("ls"))
             # A filter on the lines would be pushed below the join, to all documents.
             .groupBy("id").agg(F.min(F.get("ls", F.lit(0))).alias("line")))
    return train([r.line for r in sorted(lines.collect(), key=lambda r: str(r.id)) if r.line is not None])


def scan(docs: DataFrame, model: dict, min_probability: float = 0.5, min_similarity: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``n_paragraphs`` and ``found``: an array of (paragraph,
    start, end, family, probability, similarity, confirmed) in text order
    (paragraphs from 1, code points, end exclusive)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found_type = T.ArrayType(T.StructType([
        T.StructField("paragraph", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("family", T.StringType()),
        T.StructField("probability", T.DoubleType()), T.StructField("similarity", T.DoubleType()), T.StructField("confirmed", T.BooleanType())]))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_paragraphs", T.LongType()), T.StructField("found", found_type)])
    arrow = pa.list_(pa.struct([("paragraph", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()),
                                ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())]))
    keys = ["paragraph", "start", "end", "family", "probability", "similarity"]

    def run(batches):
        scanner = Scanner(shared.value)
        for batch in batches:
            counts, found = [], []
            for text in map(pa.StringScalar.as_py, batch.column(1)):
                counts.append(sum([not (x == "" or x.isspace()) for x in text.split("\n")]))
                found.append([dict(zip(keys, x)) | {"confirmed": x[5] >= min_similarity} for x in scanner.scan(text, min_probability, min_similarity)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, arrow)], names=["id", "n_paragraphs", "found"])

    return docs.select(F.col(id_col), text_of(text_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)
