"""Ranked search against a plain restatement, over block, owner and batch sizes."""

import math
import random
import re
from collections import Counter

import pytest

from shelfcast.llm import ranked
from tests.llm.cases import LONG, ODD, PASSAGE, clashing, documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, top=20):
    """{row of the query set: [(rank, doc_id, score)]}; documents in scan order."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in items:
        scored = []
        for k, (i, b) in enumerate(bags):
            score = 0
            for t, times in Counter(terms(text)).items():
                if t in b:
                    m = 100 - 25 + (25 * b.total() * n_docs) // n_terms
                    score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, k))
        out += [(item_id, r, None if lacking else i, -s) for r, (s, lacking, i, _) in enumerate(sorted(scored)[:top], 1)]
    return sorted(map(repr, out))


def found(docs, items, **settings):
    return sorted(repr(tuple(r)) for r in ranked.search(docs, items, **settings).select("item_id", "rank", "doc_id", "score").collect())


def corpus(n):
    rnd = random.Random(n)
    words = [f"w{int(rnd.expovariate(0.05))}" for _ in range(400)] + ["The", "the", "ÄÖ", "ß", "a_b", "x-y"]
    docs = [(i % 90 if i % 40 else None, " ".join(rnd.choices(words, k=rnd.choice([0, 1, 5, 60])))) for i in range(n)]
    docs += [(1000 + i, "copy of the same text w3 w4") for i in range(60)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.choice([1, 4, 30])))) for i in range(12)] + [(3, "the the THE"), (None, "w3"), (7, None), (8, " - ")]
    return docs, items


@pytest.mark.parametrize("owners,block_docs,batch_terms,top", [(1, 4096, 10**6, 20), (3, 7, 10**6, 20), (4, 50, 40, 3)])
def test_every_setting_gives_the_plain_ranking(spark, monkeypatch, owners, block_docs, batch_terms, top):
    monkeypatch.setattr(ranked, "BLOCK_DOCS", block_docs)
    monkeypatch.setattr(ranked, "CHUNK", 16)
    docs, items = corpus(300)
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = found(table, spark.createDataFrame(items, "item_id long, text string"), owners=owners, batch_terms=batch_terms, top=top)
    assert got == expected(docs, items, top)


def test_odd_rows(spark):
    items = [(1, PASSAGE), (2, LONG), (2, LONG), (None, "one ümläut 日本語"), (4, None), (5, ""), (6, "nowhere")]
    queries = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, ODD)
    assert found(clashing(docs), clashing(queries)) == expected([(i, t) for i, t, _, _ in ODD], items)
    assert found(documents(spark, []), queries) == []
    assert found(docs, queries.where("false")) == []
    assert found(documents(spark, [(1, None, None, None), (2, "", None, None)]), queries) == []
