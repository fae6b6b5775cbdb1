"""Licence scans with a trained paragraph classifier. Built of DataFrame functions only.

A paragraph is a line of a text. A sparse logistic regression over word n-grams names the licence
family; its last class is unknown. It is trained in numpy, when first used, on windows of the
notices below, on prose that speaks of licences without granting one, and on background windows, a
bounded sample of the corpus's whole texts; L1 shrinkage leaves few n-grams with weights. For the
calibration each notice is once left out of training with all its windows: a temperature and an
offset of the unknown class are fitted on what the models say of windows they have not met.
A predicted family is confirmed if enough of the word pairs of one of its notices stand in the
paragraph, or enough of the paragraph's pairs in the notice.

Only n-grams that hold a word seldom met in the background sample are features, so a paragraph
without any such word has the bias alone, which is unknown; these words are a pattern that most
texts fail at once. Equal paragraphs are classified once.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posegrid.session import materialise

SAMPLE_ROWS, WINDOW, FEATURES, CONFIRM, UNKNOWN, SELDOM, FOLDS, HOT = 2_000, 40, 2_000, 0.5, "unknown", 0.01, 3, 100_000
#: Words of the notices by which licences are stated.
NOTICES = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT license. See LICENSE in the project root for license information.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GPL version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-only", "Licensed under the GNU Lesser General Public License, version 2.1."],
    "BSD": [
        "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"],
    "ISC": ["Licensed under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "proprietary": ["All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.", "Proprietary and confidential.", "Copyright (c) the company. All rights reserved."],
}
#: Prose with words of licences that grants none.
PROSE = [
    "he lost his driving license", "a license is needed to fish in this lake", "the license plate of the car was stolen", "the bar got its liquor license back", "poetic license is allowed here",
    "the copyright of the song was sold last year", "copyright law protects authors for many years", "the software is sold without any permission of the owner", "all copies were distributed to the members of the public",
    "the foundation published a general report on public software", "you may use the kitchen for any purpose", "the conditions of the warranty are met", "all rights of way are marked on the map", "version 3 of the program was released in spring",
]
FAMILIES = [*NOTICES, UNKNOWN]
_WORD = "[a-z0-9]+"


def _grams(text: str) -> set[str]:
    w = re.findall(_WORD, text.lower())
    return {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}


def _any_of(words: list[str]) -> str:
    """A pattern for any of the words, with common beginnings taken together."""
    by_first: dict[str, list[str]] = {}
    for w in words:
        by_first.setdefault(w[0], []).append(w[1:])
    out = []
    for c, rest in sorted(by_first.items()):
        longer = [r for r in rest if r]
        out.append(c + (f"(?:{_any_of(longer)})" + "?" * ("" in rest) if longer else ""))
    return "|".join(out)


class Model:
    """weights: n-gram to a weight for each family; bias; heat, the temperature; words: those every
    n-gram has one of; reliability: log loss of held-out windows as fitted and as calibrated, and
    the mean gap between stated probability and share of right answers."""

    def __init__(self, background: list[str], seed: int = 5, features: int = FEATURES):
        rng = np.random.default_rng(seed)
        met: dict[str, int] = {}
        for t in background:
            for w in set(re.findall(_WORD, t.lower())):
                met[w] = met.get(w, 0) + 1
        common = {w for w, n in met.items() if n > SELDOM * len(background)} | {"the", "of", "to", "and", "or", "a", "in", "is", "for", "be", "by", "it", "this", "as", "at", "on"}
        texts, y, fold = [], [], []

        def add(text: str, family: int, part: int) -> None:
            texts.append(text)
            y.append(family)
            fold.append(part)

        for k, notices in enumerate(NOTICES.values()):
            for number, notice in enumerate(notices):
                w = notice.split()
                add(notice, k, number % FOLDS)
                for _ in range(12):
                    n = int(rng.integers(min(3, len(w)), len(w) + 1))
                    a = int(rng.integers(0, len(w) - n + 1))
                    add(" ".join(w[a : a + n]), k, number % FOLDS)
        # hard unknowns: prose, and words of all notices in no order
        for k, t in enumerate(PROSE):
            for _ in range(4):
                add(t, len(NOTICES), k % FOLDS)
        pool = [w for notices in NOTICES.values() for t in notices for w in t.split()]
        for k in range(300):
            add(" ".join(rng.choice(pool, int(rng.integers(1, 8)))), len(NOTICES), k % FOLDS)
        for k, t in enumerate(background):
            add(t, len(NOTICES), k % FOLDS)
        grams = [_grams(t) for t in texts]
        count: dict[str, int] = {}
        for g in grams:
            for x in g:
                count[x] = count.get(x, 0) + 1
        rare = lambda g: any(w not in common for w in g.split())
        names = sorted((g for g, n in count.items() if n >= 3 and rare(g)), key=lambda g: (-count[g], g))[:features]
        at = {g: i for i, g in enumerate(names)}
        x = np.zeros((len(texts), len(names)), np.float32)
        for i, g in enumerate(grams):
            own = [at[q] for q in g if q in at]
            x[i, own] = 1 / np.sqrt(max(1, len(own)))
        y_, fold_ = np.array(y), np.array(fold)
        z = np.zeros((len(texts), len(FAMILIES)), np.float32)
        for part in range(FOLDS):
            w, b = self._fit(x[fold_ != part], y_[fold_ != part])
            z[fold_ == part] = x[fold_ == part] @ w + b
        loss = lambda p, at: float(-np.log(p[np.arange(len(p)), y_[at]] + 1e-12).mean())
        unknown, every = np.eye(len(FAMILIES), dtype=np.float32)[-1], np.ones(len(y_), bool)

        def calibrated(at: np.ndarray) -> tuple[float, float]:
            tries = [(loss(self._soft((z[at] + more * unknown) / heat), at), float(heat), float(more)) for heat in np.exp(np.linspace(-2.5, 1.5, 33)) for more in np.linspace(-3, 3, 25)]
            return min(tries)[1:]

        self.heat, more = calibrated(every)
        # what is reported of a window comes from a fit and a calibration that did not see its part
        p = np.zeros_like(z)
        for part in range(FOLDS):
            heat, own = calibrated(fold_ != part)
            p[fold_ == part] = self._soft((z[fold_ == part] + own * unknown) / heat)
        sure, right = p.max(1), p.argmax(1) == y_
        bins = np.minimum((sure * 10).astype(int), 9)
        gap = sum(abs(float(sure[bins == k].mean() - right[bins == k].mean())) * float((bins == k).mean()) for k in set(bins.tolist()))
        self.reliability = {"log_loss_raw": loss(self._soft(z), every), "log_loss": loss(p, every), "calibration_error": gap, "right": float(right.mean())}
        w, b = self._fit(x, y_)
        b = b + more * unknown
        self.weights = {g: [round(float(v), 6) for v in w[i]] for g, i in at.items() if np.abs(w[i]).max() > 0}
        self.bias = [round(float(v), 6) for v in b]
        self.words = sorted({v for g in self.weights for v in g.split() if v not in common})

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def _fit(self, x: np.ndarray, y: np.ndarray, steps: int = 400, shrink: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
        """Proximal gradient: a gradient step, then each weight is drawn towards zero."""
        hot = np.eye(len(FAMILIES), dtype=np.float32)[y]
        balance = (1 / np.maximum(hot.sum(0), 1))[y]
        balance = (balance / balance.mean())[:, None].astype(np.float32)
        w, b = np.zeros((x.shape[1], len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
        for _ in range(steps):
            g = (self._soft(x @ w + b) - hot) * balance / len(y)
            w -= 8.0 * (x.T @ g)
            b -= 8.0 * g.sum(0)
            w = np.sign(w) * np.maximum(np.abs(w) - 8.0 * shrink, 0)
        return w, b


def fit_licenses(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Train with at most sample_rows background windows of WINDOW words, from anywhere in the whole
    texts of a hashed share of the documents, about sample_rows of them; windows that speak of
    licences or copyright are passed over, as they may be notices. An empty table gives no background."""
    some = docs.select(F.col(text_col).alias("text")).where("length(text) > 0")
    share = max(1, some.count() // sample_rows)
    words = some.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).select(F.split("text", "\\s+").alias("w"))
    windows = words.select(F.expr(f"explode(transform(sequence(0, size(w) - 1, {WINDOW}), i -> array_join(slice(w, i + 1, {WINDOW}), ' ')))").alias("line"))
    plain = windows.where(~F.lower("line").rlike("licen[cs]|copyright|spdx")).groupBy("line").count()
    return Model([r.line for r in plain.orderBy(F.xxhash64("line"), "line").limit(sample_rows).collect()])


def _lines(has: str) -> str:
    """SQL for an array of the lines of text that match `has`: line (from 1), start, paragraph.
    Starts are sums of the lengths of whole blocks of lines and of the few before in the own block."""
    block, total = 128, "(s, x) -> s + x"
    return f"""flatten(transform(array(split(text, '\n')), a ->
      flatten(transform(array(transform(a, x -> length(x) + 1)), n ->
        flatten(transform(array(transform(sequence(0, (size(n) - 1) div {block}), k -> aggregate(slice(n, k * {block} + 1, {block}), 0, {total}))), c ->
          flatten(transform(array(transform(sequence(0, size(c) - 1), k -> aggregate(slice(c, 1, k), 0, {total}))), d ->
            transform(filter(sequence(0, size(a) - 1), i -> lower(a[i]) rlike '{has}'),
              i -> named_struct('line', i + 1, 'start', d[i div {block}] + aggregate(slice(n, (i div {block}) * {block} + 1, i % {block}), 0, {total}), 'paragraph', a[i]))))))))))"""


def scan_licenses(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", confirm: float = CONFIRM, hot: int = HOT) -> DataFrame:
    """id, line (from 1), family, probability, similarity, n_chars and start (code points) of
    every paragraph that holds a feature of the model, in every whole text. Paragraphs are known by
    their MD5 and length from the first shuffle on, so their n-grams don't carry them.

    family is the predicted one if the similarity is at least `confirm`, else unknown: the largest,
    over the family's notices, share of the notice's word pairs that stand in the paragraph, or of the
    paragraph's that stand in the notice (of words, where the paragraph is one word). Null and empty texts have no paragraphs;
    repeated rows give repeated results; null ids stay null; columns not named are not read; empty
    tables and models without features give empty results.
    """
    spark = docs.sparkSession
    has = f"(?<![a-z0-9])(?:{_any_of(model.words) or '$^'})(?![a-z0-9])"
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.lower("text").rlike(has))
    named = F.struct(F.unhex(F.md5("paragraph")).alias("h"), F.length("paragraph").alias("n")).alias("p")
    lines = materialise(some.select("id", F.expr(f"inline({_lines(has)})")).select("id", "line", "start", named, "paragraph"), "licence-lines")
    distinct = lines.groupBy("p").agg(F.first("paragraph").alias("paragraph")).withColumn("w", F.regexp_extract_all(F.lower("paragraph"), F.lit(f"({_WORD})"), F.lit(1)))
    gram = lambda n: f"CASE WHEN size(w) >= {n} THEN transform(sequence(1, size(w) - {n - 1}), i -> array_join(slice(w, i, {n}), ' ')) ELSE cast(array() as array<string>) END"
    grams = distinct.select("p", F.expr(f"explode(array_distinct(concat({gram(1)}, {gram(2)}, {gram(3)})))").alias("gram")).withColumn("n", F.size(F.split("gram", " ")))
    # both tables are bounded: by the number of features, and by the notices
    weights = spark.createDataFrame([(g, w) for g, w in model.weights.items()], "gram string, w array<double>")
    pairs = [(f, i, g, len(g.split()), sum(len(q.split()) == 2 for q in _grams(t))) for f, ts in NOTICES.items() for i, t in enumerate(ts) for g in sorted(_grams(t)) if len(g.split()) <= 2]
    notices = spark.createDataFrame(pairs, "family string, notice int, gram string, n int, size int")
    n_f = len(FAMILIES)
    sums = grams.join(F.broadcast(weights), "gram", "left").groupBy("p").agg(
        F.count("w").alias("features"),
        *[F.sum(F.get("w", F.lit(k))).alias(f"z{k}") for k in range(n_f)],
        F.count(F.when(F.col("n") == 2, 1)).alias("pairs"),
        F.count(F.when(F.col("n") == 1, 1)).alias("singles"),
    ).where("features > 0")
    z = [(F.col(f"z{k}") / F.sqrt("features") + model.bias[k]) / model.heat for k in range(n_f)]
    top = sums.withColumn("z", F.array(*z)).withColumn("most", F.array_max("z")).withColumn("k", F.array_position("z", F.col("most")).cast("int"))
    share = F.aggregate(F.transform("z", lambda v: F.exp(v - F.col("most"))), F.lit(0.0), lambda a, v: a + v)
    guess = top.select("p", "pairs", "singles", F.array(*map(F.lit, FAMILIES))[F.col("k") - 1].alias("guess"), F.round(1.0 / share, 6).alias("probability"))
    shared = grams.join(F.broadcast(notices), ["gram", "n"]).groupBy("p", "family", "notice", "size").agg(F.count(F.when(F.col("n") == 2, 1)).alias("two"), F.count(F.when(F.col("n") == 1, 1)).alias("one"))
    near = shared.join(guess, "p").where("family = guess")
    near = near.groupBy("p").agg(F.max(F.when(F.col("pairs") > 0, F.greatest(F.col("two") / F.col("pairs"), F.col("two") / F.nullif(F.col("size"), F.lit(0)))).otherwise(F.col("one") / F.col("singles"))).alias("similarity"))
    known = guess.join(near, "p", "left").select("p", "guess", "probability", F.round(F.coalesce("similarity", F.lit(0.0)), 6).alias("similarity"))
    # a paragraph on more than `hot` lines is dealt to as many tasks as these fill
    salts = lines.groupBy("p").agg(F.ceil(F.count("*") / hot).cast("int").alias("salts")).where("salts > 1")
    salts = materialise(salts, "licence-hot")
    known = materialise(known.join(salts, "p", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts"), "licence-names")
    lines = lines.join(salts, "p", "left").withColumn("salt", F.expr("cast(pmod(xxhash64(id, line), coalesce(salts, 1)) as int)"))
    family = F.when(F.col("similarity") >= confirm, F.col("guess")).otherwise(F.lit(UNKNOWN))
    out = lines.select("id", "line", "start", "p", "salt").join(known, ["p", "salt"])
    return out.select(F.col("id").alias(id_col), "line", "start", F.col("p.n").alias("n_chars"), family.alias("family"), "probability", "similarity")
