"""Licence scan: a trained paragraph classifier confirmed by templates (operator 1).

Paragraphs (lines, long ones cut at sentence ends) are classified by a
multinomial logistic regression over word 1- to 3-grams into licence families or
``none``.  It is trained here: on the notices of ``TEMPLATES`` and the names of
``NAMES`` in the phrases of ``PHRASES``; and, as ``none``, on the same phrases
negated, on licences of no family here (``FOREIGN``), on sentences that merely speak of
licences, and on a bounded sample of corpus lines.  Phrases and lines that training does not see
calibrate it: a temperature makes the probabilities honest, and the least probability at which 99% of the
accepted ones are right separates the families from the unknown.  An accepted family is confirmed
only if the paragraph contains most of the word pairs of one of its notices or names; a paragraph that is
a notice or a name and nothing else needs a probability of one half only.
Years, numbers and the holder's name are masked in templates and paragraphs; the version and the
clause (``only``, ``or-later``) of a confirmed notice are read from its own words.

Both conditions have to hold, so the cheaper one comes first: every paragraph's
word pairs are looked up, and those without most of any template's pairs are not scored.
Names are short, so that mentions, negations and foreign licences reach the classifier, which decides.

Notices wrapped over several lines are looked for in the word stream of each block of
lines without a blank one between them (comment marks fall out): where a stretch of at
most ``SPREAD`` times a template's length holds most of its pairs, the lines it
touches are scored and confirmed as one paragraph, reported by its first line.

Edge cases: a null or empty text has no paragraph and no licence; an empty table
gives an empty result; repeated rows each return a row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, StringIndexer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.common import map_arrow, read_table, slices, staged

NONE = "none"
SAMPLE_ROWS = 400      # documents whose lines stand for text without a licence
SAMPLE_LINES = 20_000  # of those lines, the ones with the smallest hashes
MAX_TERMS = 10_000
UNIT_WORDS = 40
CONTAINED = 0.7
SPREAD = 2             # a wrapped notice lies within so many times the words of its template
#: Lines with one of these may be parts of a notice and are no examples of ``none``.
CUES = ("licen", "copyright", "public domain", "permission", "warrant", "redistribut", "spdx", "creative commons", "cc by", "cc0")

#: Notices by licence family.
TEMPLATES: dict[str, list[str]] = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache License 2.0."],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Released under the GNU General Public License.",
        "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "SPDX-License-Identifier: AGPL-3.0-only"],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0"],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC"],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-nd": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "cc-by-nc-sa": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-SA-4.0"],
    "cc-by-nc-nd": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-ND-4.0"],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0"],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense license.",
        "SPDX-License-Identifier: Unlicense"],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2020 Example Corporation. All rights reserved.",
        "No part of this work may be reproduced without the prior written permission of the copyright holder.",
        "This software is proprietary and confidential; a commercial license is required."],
}
#: Names of licences by family (two words at least, since one word confirms nothing).
NAMES: dict[str, list[str]] = {
    "apache": ["Apache License", "Apache Software License", "Apache License 2.0", "Apache-2.0"],
    "mit": ["MIT License", "MIT licence", "Expat License"],
    "bsd": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD-3-Clause"],
    "gpl": ["GNU General Public License", "GNU GPL", "GPL version 3", "GPL v2", "GPL license", "GPL-2.0-only", "GPL-3.0-or-later"],
    "lgpl": ["GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL version 3", "LGPL v2.1",
             "LGPL license", "LGPL-3.0-only", "LGPL-2.1-or-later"],
    "agpl": ["GNU Affero General Public License", "GNU AGPL", "AGPL version 3", "AGPL v3", "AGPL license", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "mpl": ["Mozilla Public License", "MPL version 2", "MPL-2.0"],
    "isc": ["ISC License", "ISC licence"],
    "cc-by": ["CC BY 4.0", "CC-BY license", "Attribution 4.0", "Creative Commons Attribution License", "Creative Commons Attribution 4.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA license", "Attribution-ShareAlike 4.0", "Creative Commons Attribution-ShareAlike License"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC license", "Attribution-NonCommercial 4.0", "Creative Commons Attribution-NonCommercial License"],
    "cc-by-nd": ["CC BY-ND 4.0", "CC-BY-ND license", "Attribution-NoDerivatives 4.0", "Creative Commons Attribution-NoDerivatives License"],
    "cc-by-nc-sa": ["CC BY-NC-SA 4.0", "CC-BY-NC-SA license", "Attribution-NonCommercial-ShareAlike 4.0",
                    "Creative Commons Attribution-NonCommercial-ShareAlike License"],
    "cc-by-nc-nd": ["CC BY-NC-ND 4.0", "CC-BY-NC-ND license", "Attribution-NonCommercial-NoDerivatives 4.0",
                    "Creative Commons Attribution-NonCommercial-NoDerivatives License"],
    "cc0": ["CC0 1.0", "CC0 license", "Creative Commons Zero", "CC0 1.0 Universal"],
    "unlicense": ["The Unlicense", "Unlicense license"],
}
#: Names of licences that belong to no family above: examples of ``none``.
FOREIGN = [
    "Eclipse Public License", "Artistic License 2.0", "zlib License", "Boost Software License 1.0", "European Union Public License",
    "SIL Open Font License 1.1", "Python Software Foundation License", "PHP License", "Microsoft Public License", "Common Development and Distribution License",
    "Academic Free License", "Open Database License", "Server Side Public License", "Business Source License 1.1", "Elastic License 2.0",
    "Do What The Fuck You Want To Public License", "Common Public License", "IBM Public License", "PostgreSQL License", "Open Government Licence v3.0",
    "GNU Free Documentation License", "Creative Commons Sampling Plus License", "Free Art License", "Beerware License"]
#: Phrases that grant a licence, and their denials.
PHRASES = ["{}", "Released under the {}.", "This work is licensed under the {}, version 3.", "License: {}", "Licensed under {}",
           "This project is distributed under the terms of the {}.", "The code is available under the {}.", "SPDX-License-Identifier: {}",
           "Published under the {}; see LICENSE.", "You may use this file under the {}.", "Covered by the {}.", "It is made available under {} terms.",
           "{}.", "{} applies to this file", "See the {} for details.", "Copying is permitted under the {}."]
DENIALS = ["This work is not licensed under the {}, version 3.", "Not released under the {}.", "This project is no longer licensed under the {}.",
           "The code is not available under the {}.", "It was never distributed under the terms of the {}.", "This cannot be copied under the {}.",
           "An article about the {} appeared in 2019.", "It cannot be shared under the {}.", "Nothing here is licensed under {}.",
           "This software isn't licensed under the {}.", "The lecture compares the {} with others.", "It is not published under {}.",
           "They refused to use the {}.", "None of this falls under the {}.", "The old {} no longer applies.", "A talk about the {} is planned."]
#: Sentences that speak of licences without granting one.
TALK = [
    "You need a driving licence to rent the car.", "The fishing license costs ten dollars a year.",
    "Her license was suspended after the accident.", "The band gave permission to film the concert.",
    "The warranty of the fridge covers two years.", "A poetic licence is no excuse for bad rhymes.",
    "He read about copyright in the morning paper.", "The city will license more taxis next year.",
    "The court decided the copyright case on Monday.", "Ask your teacher for permission before you leave.",
    "Parks are in the public domain of the town.", "The licence plate of the van was missing."]
_WORD = re.compile(r"[a-z0-9]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_MARK = re.compile(r"^\s*(?:dnl|rem)\s", re.I)   # comment marks that are words
_DIGIT = re.compile(r"[0-9]")
_YEARS = re.compile(r"\b(?:19|20)[0-9]{2}\b(?: (?:(?:19|20)[0-9]{2}|present)\b)*")
_NUMBERS = re.compile(r"\bv?[0-9]+\b(?: v?[0-9]+\b)*")
#: the version of a notice follows one of these words, its clause a version or the name
_VERSION = re.compile(r"(?:\bversion|\bv\.?|licen[cs]e,?|gpl|\bmpl|apache|\bcc0|\bby(?:-[a-z]{2})*|attribution(?:-[a-z]+)*|universal|clause)[\s,-]*v?\.?\s*([0-9]{1,2}(?:\.[0-9]+)*)\b", re.I)
_LATER = re.compile(r"\bor[ -](?:\(at your option\) )?(?:any )?later\b|\bany later version\b", re.I)
_ONLY = re.compile(r"[0-9][ -]only\b|\bversion [0-9.]+ only\b", re.I)
_HOLDER = re.compile(r"\bcopyright (?:c )?xyear (?:by )?(?:[a-z0-9]+ ){1,12}?all rights reserved\b")


def words(text: str) -> list[str]:
    """Lower-case words; years and numbers (versions) are ``xyear`` and ``xnumber``, the name in a copyright line is ``xholder``."""
    found = _WORD.findall(text.lower())
    if not _DIGIT.search(text) and "xyear" not in found:
        return found
    masked = _NUMBERS.sub("xnumber", _YEARS.sub("xyear", " ".join(found)))
    return _HOLDER.sub("copyright xyear xholder all rights reserved", masked).split()


def terms(text: str) -> list[str]:
    """Word 1- to 3-grams."""
    w = words(text)
    return [" ".join(w[i: i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def pairs(text: str) -> set[tuple[str, str]]:
    w = words(text)
    return set(zip(w, w[1:])) or {(x, "") for x in w}


def version(text: str) -> str | None:
    """The first version number that follows a licence's name or the word version."""
    found = _VERSION.search(text)
    return found.group(1) if found else None


def clause(text: str) -> str | None:
    """``or-later`` or ``only`` where the notice says so."""
    return "or-later" if _LATER.search(text) else "only" if _ONLY.search(text) else None


def blocks(text: str | None) -> list[list[str]]:
    """Paragraphs: lines with a word, long ones cut at sentence ends into units of about ``UNIT_WORDS`` words; a blank line ends a block."""
    out: list[list[str]] = [[]]
    for line in (text or "").split("\n"):
        if line.count(" ") < UNIT_WORDS:
            if line.strip():
                out[-1].append(line)
            elif out[-1]:
                out.append([])
            continue
        if not line.strip():
            if out[-1]:
                out.append([])
            continue
        held: list[str] = []
        for sentence in _SENTENCE.split(line):
            if held and sum(s.count(" ") + 1 for s in held) + sentence.count(" ") >= UNIT_WORDS:
                out[-1].append(" ".join(held))
                held = []
            held.append(sentence)
        if held:
            out[-1].append(" ".join(held))
    return [b for b in out if b]


def paragraphs(text: str | None) -> list[str]:
    return [unit for block in blocks(text) for unit in block]


def has_cue(lower: str) -> bool:
    return any(c in lower for c in CUES)


def softmax(logits: np.ndarray) -> np.ndarray:
    odds = np.exp(logits - logits.max())
    return odds / odds.sum()


@dataclass
class Model:
    families: list[str]           # class names, column order of weights
    terms: dict[str, int]
    weights: np.ndarray           # (terms, classes)
    intercepts: np.ndarray
    threshold: float
    temperature: float = 1.0

    def logits(self, paragraph: str) -> np.ndarray:
        index = [i for i in map(self.terms.get, set(terms(paragraph))) if i is not None]
        return self.intercepts + (self.weights[index].sum(axis=0) if index else 0.0)

    def probabilities(self, paragraph: str) -> np.ndarray:
        return softmax(self.logits(paragraph) / self.temperature)

    def classify(self, paragraph: str, threshold: float | None = None) -> tuple[str, float]:
        p = self.probabilities(paragraph)
        best = int(p.argmax())
        return (self.families[best] if p[best] >= (self.threshold if threshold is None else threshold) else NONE, float(p[best]))


class Templates:
    """Word pairs of all notices, with the notices of each pair."""

    def __init__(self) -> None:
        notices = [(f, n) for of in (TEMPLATES, NAMES) for f, ns in of.items() for n in ns]
        self.families = [f for f, _ in notices]
        self.pairs = [frozenset(pairs(n)) for _, n in notices]
        self.whole = set(self.pairs)
        self.of: dict[tuple[str, str], list[int]] = {}
        for k, found in enumerate(self.pairs):
            for pair in found:
                self.of.setdefault(pair, []).append(k)
        self.single = any(b == "" for _, b in self.of)   # a notice of one word

    def shares(self, found: set[tuple[str, str]]) -> dict[int, float]:
        """Share of its word pairs that each notice has among ``found``; notices without any are absent."""
        counts = Counter(k for pair in self.of.keys() & found for k in self.of[pair])
        return {k: n / len(self.pairs[k]) for k, n in counts.items()}

    def is_notice(self, paragraph: str) -> bool:
        """True if the paragraph's word pairs are those of one notice or name, no more and no less."""
        return pairs(paragraph) in self.whole

    def confirmed(self, paragraph: str) -> dict[str, float]:
        """Per family the largest share of a notice's word pairs that the paragraph contains."""
        out: dict[str, float] = {}
        for k, share in self.shares(pairs(paragraph)).items():
            out[self.families[k]] = max(out.get(self.families[k], 0.0), share)
        return out

    def candidates(self, block: list[str], contained: float = CONTAINED) -> list[tuple[int, int]]:
        """(first, last) units of the block that hold a share ``contained`` of some notice's pairs: single units, and stretches over several."""
        tokens = [words(_MARK.sub("", unit)) for unit in block]
        stream = [w for ws in tokens for w in ws]
        # a stretch has no more of a notice than the whole block
        held = set(zip(stream, stream[1:]))
        if self.single:
            held |= {(w, "") for w in stream}
        likely = [k for k, share in self.shares(held).items() if share >= contained]
        if not likely:
            return []
        unit_of = [u for u, ws in enumerate(tokens) for _ in ws]
        found = {(u, u) for u, unit in enumerate(block) if max(self.confirmed(unit).values(), default=0.0) >= contained}
        at: dict[tuple[str, str], list[int]] = {}
        for i, pair in enumerate(zip(stream, stream[1:])):
            if pair in self.of:
                at.setdefault(pair, []).append(i)
        for k in likely:
            hits = sorted((i, pair) for pair in self.pairs[k] for i in at.get(pair, ()))
            found.update((unit_of[a], unit_of[b]) for a, b in _stretches(hits, contained * len(self.pairs[k]), SPREAD * (len(self.pairs[k]) + 1)))
        return sorted(found, key=lambda c: (c[1] - c[0], c))


def _stretches(hits: list[tuple[int, tuple[str, str]]], need: float, most: int) -> Iterator[tuple[int, int]]:
    """(first, last) word of disjoint stretches of at most ``most`` words with ``need`` different pairs, widened by further new pairs."""
    left, right, inside = 0, 0, Counter()
    while right < len(hits):
        i, pair = hits[right]
        inside[pair] += 1
        right += 1
        while hits[left][0] < i + 2 - most or left < right - 1 and inside[hits[left][1]] > 1:
            inside[hits[left][1]] -= 1
            if not inside[hits[left][1]]:
                del inside[hits[left][1]]
            left += 1
        if len(inside) < need:
            continue
        first, last = hits[left][0], i + 1
        while right < len(hits) and hits[right][1] not in inside and hits[right][0] + 2 - first <= most:
            inside[hits[right][1]] += 1
            last = hits[right][0] + 1
            right += 1
        yield first, last
        left, inside = right, Counter()


def _variants() -> Iterator[tuple[str, str, bool]]:
    """(family, text, held): every notice among other words, every name in every phrase, denials, foreign names and talk; one phrase in four is held out."""
    around = [("", ""), ("This file is part of the project. ", ""), ("", " See the LICENSE file for details."), ("Note: ", " All contributors agree."),
              ("// ", ""), ("Copyright 2019 The Authors. ", ""), ("About this site. ", " Contact us by mail.")]
    for family, notices in TEMPLATES.items():
        for notice in notices:
            for k, (before, after) in enumerate(around):
                yield family, f"{before}{notice}{after}", k % 4 == 3
            yield family, notice.upper(), False
            yield family, re.sub(r"[,.()\"]", "", notice), False
            if "licensed under" in notice.lower():
                denied = re.sub("(?i)licensed under", "not licensed under", notice)
                yield NONE, denied, False
                yield NONE, f"Note: {denied}", True
    for family, names in [*NAMES.items(), (NONE, FOREIGN)]:
        for name in names:
            for k, phrase in enumerate(PHRASES):
                yield family, phrase.format(name), k % 4 == 3
            for k, phrase in enumerate(DENIALS):
                yield NONE, phrase.format(name), k % 4 == 3
    for k, talk in enumerate(TALK):
        for before in ("", "He said: ", "In 2019, "):
            yield NONE, f"{before}{talk}", k % 4 == 3


def training_rows(docs: DataFrame, rows: int = SAMPLE_ROWS, lines: int = SAMPLE_LINES) -> DataFrame:
    """(family, terms, held): made rows, and as ``none`` at most ``lines`` lines, by hash, of about ``rows`` documents, by hash."""
    spark = docs.sparkSession
    total = docs.select("doc_id").count()
    part = docs if total <= rows else docs.where(
        F.pmod(F.xxhash64(F.lit("licence"), "doc_id"), F.lit(1 << 30)) < int(rows / total * (1 << 30)))

    def background(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in batches:
            for piece in slices(batch):
                found = [" ".join(words(p)) for t in piece.column("text").to_pylist() for p in paragraphs(t)
                         if not has_cue(p.lower()) and max(templates.confirmed(p).values(), default=0.0) < CONTAINED]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["text"])

    drawn = (map_arrow(part.select("text"), background, "text string").withColumn("h", F.xxhash64(F.lit("line"), "text"))
             .orderBy("h", "text").limit(lines))
    made = [(f, " ".join(words(t)), held) for f, t, held in _variants()]
    rows_ = spark.createDataFrame(made, "family string, text string, held boolean").unionByName(
        drawn.select(F.lit(NONE).alias("family"), "text", (F.pmod("h", F.lit(4)) == 0).alias("held")))
    grams = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    one = F.col("w")

    def joined(n: int):
        return F.transform(F.slice(one, F.lit(1), F.greatest(F.size(one) - (n - 1), F.lit(0))), lambda _, i: F.array_join(F.slice(one, i + 1, F.lit(n)), " "))

    rows_ = rows_.withColumn("w", grams).withColumn("terms", F.array_distinct(F.concat(one, joined(2), joined(3))))
    return staged(rows_.select("family", "text", "terms", "held"), "licence-training")


def calibrate(model: Model, held: list[tuple[str, str]]) -> Model:
    """Temperature and threshold from (family, text) rows that training has not seen.

    The temperature of a fixed ladder with the least log loss (the smallest of equals); then the least probability
    at which 99% of the accepted rows are right, between 0.5 and 0.9.
    """
    index = {f: i for i, f in enumerate(model.families)}
    scored = [(index[f], model.logits(t)) for f, t in held]
    if scored:
        loss = {t: -sum(float(np.log(softmax(z / t)[k] + 1e-12)) for k, z in scored) for t in np.geomspace(0.25, 8, 21)}
        model.temperature = float(min(loss, key=lambda t: (loss[t], t)))
    # equal probabilities are accepted together
    found: dict[float, list[bool]] = {}
    for want, z in scored:
        p = softmax(z / model.temperature)
        best = int(p.argmax())
        if model.families[best] != NONE:
            found.setdefault(float(p[best]), []).append(best == want)
    threshold, right, k = 1.0, 0, 0
    for p in sorted(found, reverse=True):
        right, k = right + sum(found[p]), k + len(found[p])
        if right >= 0.99 * k:
            threshold = p
    model.threshold = max(0.5, min(threshold, 0.9))
    return model


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    training = training_rows(docs, rows)
    fit = training.where("not held")
    vocabulary = CountVectorizer(inputCol="terms", outputCol="features", vocabSize=MAX_TERMS, minDF=2, binary=True).fit(fit)
    index = StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc").fit(training)
    model = LogisticRegression(family="multinomial", regParam=0.0003, maxIter=80).fit(
        index.transform(vocabulary.transform(fit)).coalesce(2))
    out = Model(list(index.labels), {t: i for i, t in enumerate(vocabulary.vocabulary)},
                model.coefficientMatrix.toArray().T, model.interceptVector.toArray(), 0.5)
    # made rows and at most SAMPLE_LINES lines
    return calibrate(out, [(r["family"], r["text"]) for r in training.where("held").select("family", "text").collect()])


def scan(docs: DataFrame, model: Model, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, n_paragraphs, matches): per row the confirmed paragraphs as (paragraph number, family, version, clause, probability, containment)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found_type = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("version", pa.string()), ("clause", pa.string()), ("probability", pa.float64()),
                                     ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in batches:
            for part in slices(batch):
                counts, matches = [], []
                for text in part.column("text").to_pylist():
                    rows, before = [], 0
                    for block in blocks(text):
                        taken: list[tuple[int, int, str]] = []
                        for first, last in templates.candidates(block, contained):
                            unit = " ".join(_MARK.sub("", u) for u in block[first: last + 1])
                            # a notice and nothing else is no denial: its family needs only to be the likelier half
                            family, p = shared.value.classify(unit, 0.5 if templates.is_notice(unit) else None)
                            share = templates.confirmed(unit).get(family, 0.0)
                            if share < contained or any(f == family and a <= last and first <= b for a, b, f in taken):
                                continue
                            taken.append((first, last, family))
                            rows.append({"paragraph": before + first, "family": family, "version": version(unit), "clause": clause(unit),
                                         "probability": p, "containment": share})
                        before += len(block)
                    rows.sort(key=lambda r: (r["paragraph"], r["family"]))
                    counts.append(before)
                    matches.append(rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(matches, found_type)],
                                                 names=["doc_id", "n_paragraphs", "matches"])

    return map_arrow(
        docs.select("doc_id", "text"), run, f"doc_id {kind}, n_paragraphs long, matches array<struct<paragraph:int,family:string,version:string,clause:string,probability:double,containment:double>>")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = scan(docs, train(docs))
    families = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["family"])))
    return found.select("doc_id", "n_paragraphs", F.size("matches").cast("long").alias("n_matches"), families.alias("families"),
                        F.array_max(F.transform("matches", lambda m: m["probability"])).alias("probability"))
