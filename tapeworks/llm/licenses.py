"""License scan: a paragraph classifier with an unknown class, confirmed by templates.

Lines that don't end a sentence go on in the next one, so a paragraph may be wrapped over many lines; comment marks at
their beginning are left out. Paragraphs become sparse presence vectors of word n-grams. A multinomial logistic regression
tells licence families, licences of no known family and ordinary text apart. It is trained here: on notices made from the
templates below by dropping, changing and surrounding words, on the same with the names that tell families apart replaced
(these are of no known family), and on paragraphs of a bounded sample of documents, both ordinary ones and those that hold
a template. Its n-grams are those frequent in all of these. A temperature fitted on held-back examples calibrates the
probabilities. A paragraph is of a family if the model gives it to the families, at the family's threshold or more, and a
template of the family is found in it, better than any other's; else it is `unknown` if any licence at all is likely enough.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.common import python_rows, table

#: Notices and tags of licence families, as commonly published (fixed values).
TEMPLATES = {
    "agpl-3.0": (
        "This program is licensed under the GNU Affero General Public License, version 3.", "GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License.", "Released under the BSD License.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0"),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.", "GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License, version 3.", "GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "mit": (
        "Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT",
    ),
    "mpl-2.0": ("Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "reserved": ("All rights reserved.", "Copyright. All rights reserved. No part of this work may be reproduced without permission."),
}
#: Words that name a family: replaced by invented names, a notice is of no known family.
NAMES = frozenset("gnu affero lesser general apache mozilla mit bsd cc cc0 creative commons attribution attribution-noncommercial attribution-sharealike by by-nc by-sa 3-clause free software foundation agpl-3.0-only agpl-3.0-or-later apache-2.0 bsd-3-clause bsd-2-clause cc-by-4.0 cc-by-nc-4.0 cc-by-sa-4.0 cc0-1.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0-only gpl-3.0-or-later lgpl-3.0-only lgpl-2.1-or-later mpl-2.0".split())
FAMILIES = sorted(TEMPLATES)
NONE = "none"
UNKNOWN = "unknown"
#: The training sample: documents with the smallest hashed ids, and paragraphs taken of them at most.
MAX_DOCS, MAX_PARAGRAPHS = 1_500, 12_000
VARIANTS = 240
NGRAMS = (1, 2, 3)
#: An n-gram takes part if so many notices, or so many ordinary paragraphs, of the training examples hold it.
MIN_NOTICES, MIN_ORDINARY = 3, 30
STEPS, RATE, L2 = 250, 0.1, 1e-4
#: Share of a template's word pairs that must be there to confirm a family.
CONFIRM = 0.6
#: A class's threshold lets at most this share of held-back ordinary paragraphs through, and is at least MIN_P, or MIN_UNKNOWN
#: where no template confirms it.
FALSE_SHARE, MIN_P, MIN_UNKNOWN = 1e-3, 0.5, 0.9
#: A confirmed family has at least this part of the likeliest one's probability.
MIN_SHARE = 0.02
TOKEN = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
#: Comment marks at the beginning of a line, and what ends a paragraph's line.
MARKS = re.compile(r"^[ \t]*(?:[#*;%|>]+|//+|/\*+|--+|<!--)?[ \t]*")
CLOSED = re.compile(r"[.!?:;\u3002\uff01\uff1f][\"')\]\u201d\u2019]*[ \t\r]*(?:\*/|-->)?$")


def paragraphs(text: str | None) -> list[str]:
    """Paragraphs: lines with words, each joined with the next one while its sentence is open."""
    out, open_ = [], False
    for line in (text or "").split("\n"):
        body = MARKS.sub("", line, count=1)
        if not body or body.isspace():
            open_ = False
            continue
        if open_:
            out[-1].append(body)
        else:
            out.append([body])
        open_ = not CLOSED.search(body)
    return [" ".join(x) for x in out]


def tokens(paragraph: str) -> list[str]:
    return TOKEN.findall(paragraph.lower())


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + k]) for k in NGRAMS for i in range(len(words) - k + 1)}


PAIRS = {f: [set(zip(t, t[1:], strict=False)) for x in TEMPLATES[f] for t in [tokens(x)]] for f in FAMILIES}


def fits(words: list[str]) -> dict[str, float]:
    """The largest share of a template's word pairs that stand in the words, of each family with enough of one."""
    have = set(zip(words, words[1:], strict=False))
    shares = {f: max(len(p & have) / len(p) for p in PAIRS[f]) for f in FAMILIES}
    return {f: x for f, x in shares.items() if x >= CONFIRM}


def fitting(words: list[str]) -> list[str]:
    """The families whose templates fit best: a notice of one holds much of another's."""
    found = fits(words)
    return [f for f, x in found.items() if x == max(found.values())]


def variants(filler: list[list[str]], rng: np.random.Generator) -> Iterator[tuple[list[str], str]]:
    """Notices as they turn up: words lost or changed, and other words around."""
    junk = [w for p in filler for w in p] or ["the"]
    for family in FAMILIES:
        for i in range(VARIANTS):
            words = tokens(TEMPLATES[family][i % len(TEMPLATES[family])])
            keep = rng.random(len(words)) > (0.0 if i < len(TEMPLATES[family]) else 0.08)
            words = [w if rng.random() > 0.03 else junk[rng.integers(len(junk))] for w, k in zip(words, keep, strict=True) if k] or words
            at = int(rng.integers(len(junk)))
            before, after = (junk[at : at + int(rng.integers(0, 12))], junk[at // 2 : at // 2 + int(rng.integers(0, 12))]) if i % 2 else ([], [])
            yield before + words + after, family


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def strangers(known: list[tuple[list[str], str]], rng: np.random.Generator) -> Iterator[tuple[list[str], str]]:
    """Notices of no known family: what names the family is replaced by invented names."""
    letters = np.array(list("abcdefghijklmnoprstuvwyz"))
    for words, _ in known:
        if sum(w in NAMES for w in words):
            invented = {w: "".join(rng.choice(letters, int(rng.integers(3, 9)))) for w in NAMES}
            yield [invented.get(w, w) for w in words], UNKNOWN


def fit(sample: list[list[str]], seed: int = 0) -> dict:
    """Weights of the n-grams, bias, temperature and thresholds. sample: words of paragraphs, of any kind."""
    rng = np.random.default_rng(seed)
    held = [(p, next(iter(fitting(p)), NONE)) for p in sample if p]
    ordinary = [p for p, f in held if f == NONE]
    notices = [*variants(ordinary, rng), *(x for x in held if x[1] != NONE)]
    # As many strangers as one family has.
    drawn = [notices[i] for i in rng.permutation(len(notices))[: 2 * VARIANTS]]
    data = [*notices, *strangers(drawn, rng), *((p, NONE) for p in ordinary), ([], NONE)]
    classes = [NONE, *FAMILIES, UNKNOWN]
    sets = [grams(words) for words, _ in data]
    counts = (Counter(), Counter())
    for found, (_, family) in zip(sets, data, strict=True):
        counts[family == NONE].update(found)
    vocabulary = {g: i for i, g in enumerate(sorted({g for g, n in counts[0].items() if n >= MIN_NOTICES} | {g for g, n in counts[1].items() if n >= MIN_ORDINARY}))}
    y = np.array([classes.index(f) for _, f in data])
    # The presence matrix as the columns of its ones, row after row.
    ones = [np.fromiter((vocabulary[g] for g in found if g in vocabulary), np.int64) for found in sets]
    back = rng.random(len(data)) < 0.2
    k, n = len(classes), len(vocabulary)

    def rows(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        some = [ones[i] for i in np.flatnonzero(chosen)]
        return np.repeat(np.arange(len(some)), [len(x) for x in some]), np.concatenate(some) if some else np.zeros(0, np.int64), len(some)

    def times(part: tuple[np.ndarray, np.ndarray, int], w: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(part[0], w[part[1], c], part[2]) for c in range(k)], 1)

    train, yt = rows(~back), y[~back]
    w, b = np.zeros((n, k)), np.zeros(k)
    weight = (1 / np.bincount(yt, minlength=k).clip(1))[yt]
    weight[yt == 0] *= 4
    weight /= weight.sum()
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, STEPS + 1):
        p = softmax(times(train, w) + b)
        p[np.arange(len(yt)), yt] -= 1
        p *= weight[:, None]
        gw, gb = np.stack([np.bincount(train[1], p[train[0], c], n) for c in range(k)], 1) + L2 * w, p.sum(0)
        mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= RATE * (mw / (1 - 0.9**t)) / (np.sqrt(vw / (1 - 0.99**t)) + 1e-7)
        b -= RATE * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-7)
    z, yb = times(rows(back), w) + b, y[back]
    losses = {t: -np.log(softmax(z / t)[np.arange(len(yb)), yb] + 1e-12).mean() for t in np.geomspace(0.25, 8, 41)} if len(yb) else {1.0: 0.0}
    temperature = min(losses, key=losses.get)
    p = softmax(z / temperature)[yb == 0]
    p[:, -1] = 1 - p[:, 0]  # any licence, known or not
    thresholds = {f: float(max(MIN_UNKNOWN if f == UNKNOWN else MIN_P, np.quantile(p[:, i + 1], 1 - FALSE_SHARE) if len(p) else 0)) for i, f in enumerate(classes[1:])}
    return {"classes": classes, "vocabulary": vocabulary, "weights": w.astype(np.float32), "bias": b, "temperature": float(temperature), "thresholds": thresholds}


class Scanner:
    """Classifies the paragraphs of texts; only n-grams with weights are looked at."""

    def __init__(self, model: dict):
        self.model = model

        # What one word can add to a family over ordinary text at most: paragraphs of too little are skipped exactly.
        w = model["weights"]
        gain = (w[:, 1:] - w[:, :1]).max(1)
        self.gain = {}
        for g, i in model["vocabulary"].items():
            if gain[i] > 0:
                first = g.split(" ")[0]
                self.gain[first] = self.gain.get(first, 0.0) + float(gain[i])
        self.need = float(model["bias"][0] - model["bias"][1:].max())
        self.known: dict[str, tuple[str, str, float]] = {}

    def paragraph(self, words: list[str]) -> tuple[str, str, float]:
        """(verdict, likeliest family or none, probability)."""
        m = self.model
        at = [m["vocabulary"][g] for g in grams(words) if g in m["vocabulary"]]
        p = softmax(((m["weights"][at].sum(0) + m["bias"]) / m["temperature"])[None])[0]
        best = int(p.argmax())
        family = m["classes"][best]
        if not best:
            return NONE, NONE, float(p[0])
        # The likeliest family that no other one's template fits better; families that share their words share probability too.
        for i in sorted((m["classes"].index(f) for f in fitting(words)), key=lambda i: -p[i]):
            if p[1:-1].sum() >= m["thresholds"][m["classes"][i]] and p[i] >= MIN_SHARE * p[1:-1].max():
                return m["classes"][i], m["classes"][i], float(p[i])
        # No family for sure: a licence all the same, if ordinary text is unlikely enough.
        return (UNKNOWN, family, float(1 - p[0])) if 1 - p[0] >= m["thresholds"][UNKNOWN] else (NONE, NONE, float(p[0]))

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str, str, float]]]:
        """Number of paragraphs with words, and (paragraph, verdict, family, probability) of those that aren't ordinary."""
        lines = paragraphs(text)
        low = (text or "").lower()
        found = []
        if sum(self.gain.get(w, 0.0) for w in self.gain.keys() & set(TOKEN.findall(low))) > self.need:
            for i, line in enumerate(lines):
                words = tokens(line)
                if sum(self.gain[w] for w in self.gain.keys() & set(words)) > self.need and (got := self.paragraph(words))[0] != NONE:
                    found.append((i, *got))
        return len(lines), found


def _scan(model: dict, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    scanner = Scanner(model)
    for batch in batches:
        out = []
        for text in batch["text"]:
            n, found = scanner.scan(text)
            sure = [x for x in found if x[1] != UNKNOWN]
            best = max(sure or found, key=lambda x: (x[3], -x[0]), default=(0, NONE, NONE, 0.0))
            out.append((n, len(sure), len(found) - len(sure), best[1], best[3], ",".join(sorted({x[1] for x in sure}))))
        yield pd.DataFrame(out, columns=["n_paragraphs", "n_licensed", "n_unknown", "license", "score", "families"]).assign(doc_id=batch["doc_id"].values)


def _paragraphs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [tokens(x) for text in batch["text"] for x in paragraphs(text)]
        yield pd.DataFrame({"words": pd.Series([x for x in found if x], dtype=object)})


def train(docs: DataFrame, *, max_docs: int = MAX_DOCS, max_paragraphs: int = MAX_PARAGRAPHS) -> dict:
    """The model; ordinary text is taught by paragraphs of at most max_docs documents. Works on an empty table too."""
    python_rows(docs.sparkSession)
    ids = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInPandas(_paragraphs, "words array<string>")
    # of the sample's paragraphs those with the smallest hashes
    found = rows.orderBy(F.xxhash64("words")).limit(max_paragraphs).toPandas()
    return fit([list(w) for w in found["words"]])


def license_scan(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, n_paragraphs, n_licensed, n_unknown, license, score and families of every row of docs (doc_id, text).

    license is the surest family of the document, `unknown` where only unconfirmed licence-like paragraphs are found, or
    `none` with score 0. Null and empty texts have no paragraphs. Repeated rows each get a row; other columns are
    ignored; an empty table gives no rows.
    """
    model = model or train(docs)
    python_rows(docs.sparkSession)
    schema = "n_paragraphs long, n_licensed long, n_unknown long, license string, score double, families string, doc_id long"
    return docs.select("doc_id", "text").mapInPandas(partial(_scan, model), schema).select("doc_id", "n_paragraphs", "n_licensed", "n_unknown", "license", "score", "families")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License families of every document."""
    return license_scan(table(spark, sf_dir, "documents", "doc_id", "text"))
