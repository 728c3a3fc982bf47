"""The Merkle manifest against a plain restatement, for every superblock size."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from shelfcast.llm import manifest
from tests.llm.cases import ODD, clashing, documents


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    doc_id, text, lang, source, n_chars = row
    if lower and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, i):
    for level in levels[:-1]:
        run = i - i % 8
        yield level[run:i], level[i + 1:run + 8]
        i //= 8


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = climb([leaf(r) for r in groups[g]])
    upper = climb([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, row in enumerate(groups[g]):
            way = [*path(trees[g], i), *path(upper, k)]
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            node = leaf(row, lower=hit)
            for before, after in way:
                node = H(*before, node, *after)
            out.append((row[0], leaf(row), trees[g][-1][0], upper[-1][0], H(*[x for b, a in way for x in b + a]), node, node == upper[-1][0]))
    return sorted(map(repr, out))


def found(docs, **settings):
    third = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0, F.lit(False))
    out = manifest.manifest(manifest.document_leaves(docs, third), **settings)
    return sorted(repr(tuple(r)) for r in out.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


@pytest.mark.parametrize("span", [1, 2, 3])
def test_every_layer_size(spark, span):
    rows = [(i, f"Text {i % 50} OF {i}", ["a", "b", None, "ä", ""][min(i % 7, 4)], None, i) for i in range(300)]
    rows += [(i, "lone", f"g{i}", "s", 4) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert found(docs, span=span) == expected(rows)


def test_odd_rows(spark):
    docs = documents(spark, ODD)
    want = expected([tuple(r) for r in docs.collect()])
    assert found(clashing(docs)) == want
    assert found(docs, span=1) == want


def test_one_group_one_row_and_none(spark):
    one = documents(spark, [(3, "Alone", "en", None)])
    assert found(one) == expected([tuple(r) for r in one.collect()])
    same = documents(spark, [(7, "Copy", "en", "a")] * 30)
    assert found(same, span=1) == expected([tuple(r) for r in same.collect()])
    assert found(documents(spark, [])) == []


def test_proofs_fold_to_the_root(spark):
    docs = documents(spark, [(i, f"text {i}", "en" if i % 3 else "de", "a") for i in range(70)])
    for r in manifest.manifest(manifest.document_leaves(docs), span=1, proofs=True).collect():
        assert manifest.fold(r.leaf, [tuple(x) for x in r.proof]) == r.root and r.verified
