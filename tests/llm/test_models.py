"""Language, toxicity and licence models: held-out accuracy and odd rows."""

import numpy as np
from pyspark.sql import functions as F

from shelfcast.llm import language, licences, toxicity
from shelfcast.llm.common import fold
from tests.conftest import SF_MID
from tests.llm.cases import ODD, clashing, documents


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    got = language.op6_language_id(spark, SF_MID).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(spark):
    docs = documents(spark, ODD)
    model = language.train(docs, rows=1000)
    got = language.predict(clashing(docs), model)
    rows = got.select("doc_id", "lang_pred", "score", "fp").collect()
    assert len(rows) == len(ODD)
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1, 2, 3, 11))
    assert language.predict(documents(spark, []), model).count() == 0
    kept = language.identified(clashing(docs))
    assert kept.columns == clashing(docs).columns and {r.doc_id for r in kept.collect()} == {None, 4, 5, 6, 7, 8, 9, 10}
    empty = language.train(documents(spark, []))
    assert {r.lang_pred for r in language.predict(docs, empty).collect()} == {"und"}


def test_small_languages_keep_their_share(spark, monkeypatch):
    rows = [(i, " ".join(f"{a}{b}common" for a in "abcdefgh" for b in "klmno"), "en", "s") for i in range(800)]
    rows += [(1000 + i, "zhuvro plimka zhuvro", "xx", "s") for i in range(8)]
    docs = documents(spark, rows)
    taken = language.training_rows(docs, rows=100).groupBy("lang").count().collect()
    small = docs.where((fold(F.col("doc_id")) != 0) & (F.col("lang") == "xx")).count()
    assert small and dict(map(tuple, taken))["xx"] == small and 50 < dict(map(tuple, taken))["en"] < 150
    assert language.shares({"a": 3, "b": 500, "c": 90}, 100) == {"a": 3, "b": 48.5, "c": 48.5}
    monkeypatch.setattr(language, "MAX_WORDS", 20)
    monkeypatch.setattr(language, "MAX_GRAMS", 20)
    model = language.train(docs, rows=100)
    assert len(model.words) == 20 and {"zhuvro", "plimka"} <= set(model.words)
    assert language.predict(documents(spark, [(1, "plimka", None, None)]), model).first().lang_pred == "xx"


def test_language_backs_off_to_shorter_grams(spark):
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate([("hello world winter", "en"), ("bonjour monde hiver", "fr")] * 30)]
    model = language.train(documents(spark, rows))
    scorer = language.Scorer(model)
    best = lambda w: model.langs[int(scorer.documents([[w]])[0].argmax())]
    assert best("hello") == "en" and best("bonjour") == "fr"        # known
    assert best("helloes") == "en" and best("bonjours") == "fr"     # unseen: n-grams
    assert scorer._backoff("zzz") == []


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.op4_toxicity_gbt(spark, SF_MID)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").where("held_out").collect()
    pos, neg = [[r.score for r in rows if r.toxic == k] for k in (1, 0)]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.9 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_odd_rows(spark):
    docs = documents(spark, ODD + [(100 + i, ("you idiot moron " if i % 2 else "a calm day ") * 5, "en", "a") for i in range(80)])
    labels = spark.createDataFrame([(100 + i, 1, i % 2) for i in range(80)] + [(100, 0, None), (None, 1, 1), (9999, 1, 1), (101, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    model = toxicity.train(clashing(docs), labels, trees=3)
    got = {r.doc_id: r for r in toxicity.predict(clashing(docs), model).collect()}
    assert toxicity.predict(docs, model).count() == docs.count()
    assert got[101].predicted == 1 and got[102].predicted == 0
    none = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.predict(docs, none).collect()} == {0.0}
    assert toxicity.predict(documents(spark, []), model).count() == 0
    assert not docs.join(labels, "doc_id").where(fold(F.col("doc_id")) != 0).isEmpty()


def test_licences(spark):
    notices = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.",
               "This work is licensed under the GNU General Public License, version 3."]
    docs = documents(spark, ODD + [(100 + k, f"some words first\n{n}\nand after", "en", "a") for k, n in enumerate(notices)]
                     + [(200, "You need a driving licence to rent the car.", "en", "a"), (201, "A licence is a warranty of nothing.", "en", "a")])
    model = licences.train(docs)
    rows = {r.doc_id: r for r in licences.scan(clashing(docs), model).collect()}
    assert [[m.family for m in rows[100 + k].matches] for k in range(4)] == [["apache"], ["mit"], ["cc-by-nc"], ["gpl"]]
    assert rows[100].matches[0].paragraph == 1 and rows[100].n_paragraphs == 3
    assert not rows[200].matches and not rows[201].matches and rows[1].n_paragraphs == 0
    assert licences.scan(docs, model).count() == docs.count() and licences.scan(documents(spark, []), model).count() == 0


def test_licence_notices_without_a_cue_word(spark):
    notices = {"All rights reserved.": "proprietary", "ALL RIGHTS RESERVED": "proprietary", "Copyright 2021 Acme Inc. All rights reserved.": "proprietary",
               "Copyright (c) 2019-2023 The Foo Project Authors. All rights reserved.": "proprietary", "Licensed under the Apache License, Version 1.1.": "apache"}
    docs = documents(spark, ODD + [(100 + k, f"some words first\n{n}\nand after", "en", "a") for k, n in enumerate(notices)])
    rows = {r.doc_id: r for r in licences.scan(docs, licences.train(docs)).collect()}
    assert [[(m.paragraph, m.family) for m in rows[100 + k].matches] for k in range(len(notices))] == [[(1, f)] for f in notices.values()]
    assert not rows[4].matches
    assert licences.words("Copyright (c) 2021 Acme Inc. All rights reserved, v2.0") == "copyright xyear xholder all rights reserved xnumber".split()
    for text in (n for ns in licences.TEMPLATES.values() for n in ns):
        assert licences.words(" ".join(licences.words(text))) == licences.words(text)


#: sentences in no template: family, version and clause, or nothing (denied, foreign, or only mentioned)
UNSEEN = {
    "Licensed under CC BY-NC-ND 4.0.": ("cc-by-nc-nd", "4.0", None),
    "Attribution-NoDerivatives 4.0": ("cc-by-nd", "4.0", None),
    "This work is not licensed under the GNU General Public License, version 3.": None,
    "Released under the GNU Lesser General Public License.": ("lgpl", None, None),
    "Released under the GNU Affero General Public License.": ("agpl", None, None),
    "SPDX-License-Identifier: GPL-2.0-only": ("gpl", "2.0", "only"),
    "SPDX-License-Identifier: LGPL-3.0-only": ("lgpl", "3.0", "only"),
    "MIT License": ("mit", None, None),
    "Everything in this folder is offered under the MIT License.": ("mit", None, None),
    "Dual use is fine; the sources carry the Apache License, version 2.0.": ("apache", "2.0", None),
    "The photos are shared under CC BY-SA 3.0.": ("cc-by-sa", "3.0", None),
    "You can copy this under the GNU GPL, version 2 or any later version.": ("gpl", "2", "or-later"),
    "Our library is free software under the BSD 2-Clause License.": ("bsd", None, None),
    "This tool is not distributed under the MIT License.": None,
    "The images are not available under CC BY 4.0.": None,
    "She wrote a thesis about the GNU General Public License.": None,
    "Released under the Eclipse Public License.": None,
    "Licensed under the Open Software License 3.0": None,
    "Licensed under the Vim License.": None,
}


def test_licences_in_no_template(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    model = licences.train(docs)
    assert 0.5 <= model.threshold <= 0.9 and 0.25 <= model.temperature <= 8
    rows = documents(spark, [(k, f"some words first\n{n}\nand after", "en", "a") for k, n in enumerate(UNSEEN)])
    got = {r.doc_id: [tuple(m)[1:4] for m in r.matches] for r in licences.scan(rows, model).collect()}
    assert got == {k: [w] if w else [] for k, w in enumerate(UNSEEN.values())}


def test_licence_training_rows_are_bounded_and_repeatable(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    drawn = lambda: sorted((r.family, r.text, r.held) for r in licences.training_rows(docs, lines=50).collect())
    made = list(licences._variants())
    first = drawn()
    assert first == drawn() and len(first) == len(made) + 50
    # calibration alone: three of four rows of probability 0.8 right, all above; logits give the probabilities
    model = licences.Model(["a", "none"], {}, np.zeros((0, 2)), np.log([0.8, 0.2]), 0.5)
    assert licences.calibrate(model, [("a", "x")] * 3 + [("none", "x")]).threshold == 0.9
    assert abs(model.probabilities("x")[0] - 0.75) < 0.02     # tempered towards the share that is right


WRAPPED = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights""",
    "bsd": """// Redistribution and use in source and binary forms, with or without
// modification, are permitted provided that the following conditions are
// met:""",
    "gpl": """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or""",
    "isc": """dnl Permission to use, copy, modify, and/or distribute this software for any
dnl purpose with or without fee is hereby granted, provided that the above
dnl copyright notice and this permission notice appear in all copies.""",
    "lgpl": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either""",
}


def test_wrapped_licence_notices(spark):
    docs = documents(spark, ODD + [(100 + k, f"some words first\nand more\n\n{n}\n\nand after", "en", "a") for k, n in enumerate(WRAPPED.values())])
    rows = {r.doc_id: r for r in licences.scan(docs, licences.train(docs)).collect()}
    assert [[m.family for m in rows[100 + k].matches] for k in range(len(WRAPPED))] == [[f] for f in WRAPPED]
    assert rows[100].matches[0].paragraph == 2 and rows[100].n_paragraphs == 6
    halves = WRAPPED["isc"].split("\n")[:2]
    apart = documents(spark, [(1, f"{halves[0]}\n\n{halves[1]}", "en", "a"), (2, f"{halves[0]}\n{'other words here ' * 12}\n{halves[1]}", "en", "a")])
    assert all(not r.matches for r in licences.scan(apart, licences.train(docs)).collect())


def test_a_text_without_white_space_takes_linear_time(spark):
    """A megabyte of letters, with and without masks, gives the same hits as the plain pattern on small texts."""
    import random
    import re
    import time

    import pyarrow as pa
    from shelfcast.llm import toxicity
    plain = re.compile(r"[^\W\d_]+[*@$013457!]+[^\W_]+")
    rnd = random.Random(4)
    for _ in range(3000):
        text = "".join(rnd.choice("abé*@1!5_ -") for _ in range(rnd.randint(0, 30)))
        assert toxicity._MASKED.findall(text) == plain.findall(text)
    began = time.perf_counter()
    rows = toxicity.feature_rows(pa.array(["x" * 1_000_000, "日" * 300_000, "aB1" * 300_000, "!" * 1_000_000, "A" * 1_000_000]), toxicity.Lexicon())
    assert rows.shape[0] == 5 and time.perf_counter() - began < 20
