"""License scans: a trained paragraph classifier names the family of a license, templates confirm it."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafold.llm.batches import LOWER, WORD_BYTES, flat, map_texts, mix, rows_of, span_hashes, spans
from spectrafold.llm.samples import labelled_sample

# Wordings by family.
TEMPLATES = {
    "Apache": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License",
               "Apache Software License", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
            "The MIT License (MIT)", "SPDX-License-Identifier: MIT"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3", "under the terms of the GNU General Public License as published by the Free Software Foundation",
            "SPDX-License-Identifier: GPL-3.0-or-later"],
    "LGPL": ["licensed under the GNU Lesser General Public License, version 2.1", "under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1"],
    "AGPL": ["licensed under the GNU Affero General Public License, version 3", "under the terms of the GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Licensed under the BSD 3-Clause License",
            "Use of this source code is governed by a BSD-style license", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0": ["dedicated to the public domain under CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License"],
    "Proprietary": ["All rights reserved", "proprietary and confidential, unauthorized copying of this file is strictly prohibited"],
}
# Sentences with such words that are no license, and licenses of no known family.
HARMLESS = ["he lost his driving license on the road", "the license plate of the car", "a fishing license is sold at the office", "the general public was free to use the software",
            "version 2 of the report is attached", "the rights of the public are reserved for the court", "a copy of this software was sold", "poetic license of the author", "the MIT campus",
            "apache helicopters flew over", "the mozilla browser", "the source code is written in c"]
OTHER = ["Licensed under the Foobar Community License, version 7", "Released under the Example Source License", "This work is licensed under the terms of the Orchid Agreement",
         "SPDX-License-Identifier: LicenseRef-Own"]

NONE, UNKNOWN = "none", "unknown"
#: Words of an n-gram at most, and length of the table of features.
GRAMS, BUCKETS = 3, 1 << 20
#: Paragraphs of the corpus that are examples of no license come from at most this many texts.
MAX_TRAIN, EXAMPLES, STEPS, RATE, SPARSE = 500, 60, 120, 0.5, 2e-4
#: A paragraph names a family if the classifier and a template's share of n-grams reach these.
PRECISION, CONFIRM = 0.98, 0.6


@dataclass
class Model:
    names: list[str]
    slot: np.ndarray  # BUCKETS: row of the weights, 0 for features without weight
    weights: np.ndarray  # (features + 1, names); row 0 is zero
    bias: np.ndarray
    least: float  # calibrated probability below which a license has no known family


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, paragraph, row of each paragraph): n-grams of the paragraphs (lines) of texts, none over two paragraphs."""
    data, offsets = flat(texts)
    breaks = np.flatnonzero(data == 0x0A) + 1
    begins = np.unique(np.r_[offsets[:-1], breaks])
    row = rows_of(begins, offsets) if len(data) else np.arange(len(texts))
    starts, ends = spans(LOWER[data], offsets, WORD_BYTES)
    paragraph = np.searchsorted(begins, starts, "right") - 1
    words = span_hashes(LOWER[data], starts, ends)
    hashes, owners, running = [], [], np.zeros(len(words), np.uint64)
    for n in range(GRAMS):
        size = len(words) - n
        if size <= 0:
            break
        running[:size] += mix(words[n:] + np.uint64(n * 0x9E37 + 1))
        whole = paragraph[n:] == paragraph[:size]
        hashes.append(mix(running[:size][whole] + np.uint64(n)).view(np.int64))
        owners.append(paragraph[:size][whole])
    none = np.zeros(0, np.int64)
    return np.concatenate(hashes or [none]), np.concatenate(owners or [none]), row


def _grams(text: str) -> set[int]:
    return set(features(pa.array([text.replace("\n", " ")]))[0].tolist())


_TEMPLATE_GRAMS = None


def confirmed(family: str, grams: set[int]) -> float:
    """Largest share of the n-grams of one of the family's templates that a paragraph has."""
    global _TEMPLATE_GRAMS
    if _TEMPLATE_GRAMS is None:
        _TEMPLATE_GRAMS = {f: [_grams(t) for t in texts] for f, texts in TEMPLATES.items()}
    return max(len(t & grams) / len(t) for t in _TEMPLATE_GRAMS[family])


def generated(rng: np.random.Generator, plain: list[str], each: int) -> tuple[list[str], list[str]]:
    """Labelled paragraphs: wordings with other numbers, owners and surroundings; parts of plain paragraphs for the rest."""
    texts, labels = [], []
    pools = TEMPLATES | {UNKNOWN: OTHER, NONE: HARMLESS}

    def part() -> str:
        words = plain[int(rng.integers(len(plain)))].split() if plain else []
        at = int(rng.integers(0, max(1, len(words) - 12)))
        return " ".join(words[at:at + int(rng.integers(0, 12))])

    for family, pool in pools.items():
        for _ in range(each):
            text = re.sub(r"\d+", lambda _m: str(rng.integers(1, 5)), str(rng.choice(pool))) if rng.random() < 0.5 else str(rng.choice(pool))
            lead = str(rng.choice(["", "", part(), f"Copyright (c) {rng.integers(1990, 2030)} {part()[:20]}."]))
            texts.append(f"{lead} {text}{rng.choice(['.', '', ';'])} {part() if rng.random() < 0.4 else ''}")
            labels.append(family)
    texts += [x for x in plain[:20 * each] if not re.search("licen|copyright|rights reserved", x, re.I)]
    return texts, labels + [NONE] * (len(texts) - len(labels))


def fit(plain: list[str], seed: int = 9) -> Model:
    """Multinomial logistic regression on n-gram presence, made sparse by soft thresholds.

    A quarter of the examples calibrates *least*: the smallest probability from which named families are right in PRECISION
    of cases; wordings of no family count as wrong.
    """
    rng = np.random.default_rng(seed)
    texts, labels = generated(rng, plain, EXAMPLES)
    names = [NONE, *TEMPLATES]
    y = np.array([names.index(x) if x in names else -1 for x in labels])
    grams, owner, _ = features(pa.array([t.replace("\n", " ") for t in texts]))
    bucket = grams & (BUCKETS - 1)
    pairs = np.unique(owner * BUCKETS + bucket)
    owner, bucket = pairs // BUCKETS, pairs % BUCKETS
    check = rng.permutation(len(y)) % 4 == 3
    used = ~check & (y >= 0)
    known, place = np.unique(bucket[used[owner]], return_inverse=True)
    o = owner[used[owner]]
    weights, bias = np.zeros((len(known), len(names))), np.zeros(len(names))
    target = np.zeros((len(y), len(names)))
    target[np.flatnonzero(used), y[used]] = 1
    balance = used / np.maximum(1, np.bincount(y[used], minlength=len(names)))[np.maximum(y, 0)]
    total = np.zeros_like(weights) + 1e-8
    for _ in range(STEPS):
        logits = np.zeros((len(y), len(names)))
        np.add.at(logits, o, weights[place])
        p = np.exp(logits + bias - (logits + bias).max(axis=1, keepdims=True))
        error = balance[:, None] * (p / p.sum(axis=1, keepdims=True) - target) / len(names)
        gradient = np.zeros_like(weights)
        np.add.at(gradient, place, error[o])
        total += gradient**2
        step = RATE / np.sqrt(total)
        weights = weights - step * gradient
        weights = np.sign(weights) * np.maximum(np.abs(weights) - step * SPARSE, 0)
        bias -= RATE * error.sum(axis=0)
    alive = np.abs(weights).max(axis=1) > 1e-3
    slot = np.zeros(BUCKETS, np.int32)
    slot[known[alive]] = np.arange(1, alive.sum() + 1)
    model = Model(names, slot, np.vstack([np.zeros(len(names)), weights[alive]]).astype(np.float32), bias, 0.0)
    best, p = _predict(model, slot[bucket], owner, len(y))
    named = check & (best > 0)
    order = np.flatnonzero(named)[np.argsort(-p[named])]
    right = np.cumsum(best[order] == y[order]) / np.arange(1, len(order) + 1)
    enough = np.flatnonzero(right >= PRECISION)
    model.least = float(p[order[enough[-1]]]) if len(enough) else 1.0
    return model


def _predict(model: Model, slots: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(likeliest name, its probability) of each of *n* paragraphs."""
    some = slots > 0
    logits = np.zeros((n, len(model.names)))
    np.add.at(logits, owner[some], model.weights[slots[some]])
    logits += model.bias
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return p.argmax(axis=1), p.max(axis=1)


def _possible(model: Model, slots: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Paragraphs that may be taken for a license: those for which all that speaks for some family, counted as often as it
    occurs, outweighs the bias for none. The others can't be; most have next to nothing that speaks for one."""
    over_none = model.weights[:, 1:] - model.weights[:, :1]
    gain = np.maximum(over_none.max(axis=1), 0.0)
    some = np.flatnonzero(gain[slots] > 0)
    total = np.bincount(owner[some], gain[slots[some]], minlength=n)
    return np.flatnonzero(total + (model.bias[1:] - model.bias[0]).max() > 0)


def _distinct(owner: np.ndarray, grams: np.ndarray, wanted: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(place in *wanted*, n-gram) of the distinct n-grams of the *wanted* paragraphs (sorted), of those under *mask*."""
    place = np.full(int(owner.max(initial=0)) + 1, -1)
    place[wanted] = np.arange(len(wanted))
    part = place[owner]
    kept = part >= 0 if mask is None else (part >= 0) & mask
    part, gram = part[kept], grams[kept]
    by = np.lexsort((gram, part))
    part, gram = part[by], gram[by]
    new = np.ones(len(part), bool)
    new[1:] = (part[1:] != part[:-1]) | (gram[1:] != gram[:-1])
    return part[new], gram[new]


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_train: int = MAX_TRAIN) -> Model:
    """A model; paragraphs of at most *max_train* texts, the same ones in any run, show what is no license."""
    found = labelled_sample(docs, docs, id_column, text_column, F.lit(1), max_train)
    return fit([line for text, _ in found for line in text.split("\n") if line.strip()])


def scan(docs: DataFrame, model: Model, text_column: str = "text", into: str = "licenses") -> DataFrame:
    """The columns of *docs* but the text, and *into*: array of (paragraph, family, score, template) in text order.

    Paragraphs are lines, numbered from 0. A paragraph that the classifier takes for a license has its family if the
    probability reaches the calibrated bound and a template of the family shares CONFIRM of its n-grams; else "unknown",
    which needs a word of licensing itself. Whole texts are read; null and empty ones have none; repeated rows stay; a
    column named *into* is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("score", pa.float64()), ("template", pa.float64())]))

    def run(texts: pa.Array) -> dict:
        m = shared.value
        grams, owner, row = features(texts)
        slots = m.slot[grams & (BUCKETS - 1)]
        touched = _possible(m, slots, owner, len(row))
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        if len(touched):
            part, gram = _distinct(owner, grams, touched, slots > 0)
            best, p = _predict(m, m.slot[gram & (BUCKETS - 1)], part, len(touched))
            taken = np.flatnonzero(best > 0)
            part, gram = _distinct(owner, grams, touched[taken], None)
            cuts = np.searchsorted(part, np.arange(len(taken) + 1))
            first = np.searchsorted(row, np.arange(len(texts)))
            for j, i in enumerate(taken.tolist()):
                family, mine = m.names[best[i]], set(gram[cuts[j]:cuts[j + 1]].tolist())
                share = confirmed(family, mine)
                if p[i] < m.least or share < CONFIRM:
                    if not mine & _WORDS:
                        continue
                    family = UNKNOWN
                r = int(row[touched[i]])
                out[r].append({"paragraph": int(touched[i] - first[r]), "family": family, "score": float(p[i]), "template": float(share)})
        return {into: pa.array(out, kind)}

    return map_texts(docs.drop(into), run, f"`{into}` array<struct<paragraph:bigint,family:string,score:double,template:double>>", text_column)


#: A paragraph of an unknown license has one of these words.
_WORDS = set().union(*(_grams(w) for w in ("license", "licensed", "licence", "licenced", "copyright")))
