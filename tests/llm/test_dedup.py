"""SimHash near-duplicates and repeated passages against brute force."""

from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from shelfcast.llm import simhash, substrings
from tests.conftest import SF_SMALL
from tests.llm.cases import LONG, ODD, PASSAGE, clashing, documents, rows_of


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[k: k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(set(fps)), 2):
        if (a ^ b).bit_count() <= bits:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def check_simhash(df, found):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in df.select("doc_id", "text").collect()]
    root = brute_components([f for _, f in rows], 4)
    least = {}
    for i, f in rows:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = sorted(repr((i, f, least.get(root[f]))) for i, f in rows)
    assert sorted(repr((r.doc_id, r.fp % 2**64, r.component_id)) for r in found.collect()) == want


def test_simhash_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    check_simhash(docs, simhash.near_duplicates(docs))


@pytest.mark.parametrize("wrap", [lambda d: d, clashing])
def test_simhash_odd_rows(spark, wrap):
    docs = wrap(documents(spark, ODD))
    check_simhash(docs, simhash.near_duplicates(docs))


def test_simhash_empty_table(spark):
    docs = documents(spark, [])
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_one(docs).count() == 0


@pytest.mark.parametrize("limit", [2, 5, 4096])
def test_links_are_whole_whatever_the_group_limit(spark, limit):
    """Clusters and chains of fingerprints; small limits force refiled groups and dealt pairs."""
    import random
    rnd = random.Random(limit)
    fps = set()
    for _ in range(12):
        x = rnd.getrandbits(64)
        for _ in range(25):
            fps.add(x)
            for b in rnd.sample(range(64), rnd.randint(0, 6)):
                x ^= 1 << b
    fps |= {rnd.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    roots = {r.node % 2**64: r.root % 2**64 for r in simhash.components(simhash.links(df, 4, limit)).collect()}
    want = brute_components(list(fps), 4)
    classes = {}
    for f in fps:
        classes.setdefault(roots.get(f, f), set()).add(f)
    other = {}
    for f, r in want.items():
        other.setdefault(r, set()).add(f)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, other.values()))


def test_keep_one_keeps_the_smallest_id_once(spark):
    docs = documents(spark, [(4, "same text of some words here", "en", "a"), (2, "same text of some words here", "en", "b"),
                             (2, "same text of some words here", "en", "b"), (9, "something else entirely now", "en", "a")])
    kept = simhash.keep_one(clashing(docs))
    assert kept.columns == clashing(docs).columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 9]


def brute_repeats(rows, window):
    """(id, n_words, n_removed, kept words) per row; ``rows``: (id, text)."""
    first = {}
    words = [(t or "").encode().split() for _, t in rows]
    at = lambda i: -(2**63) if i is None else i
    for (i, _), w in zip(rows, words):
        for p in range(len(w) - window + 1):
            key = tuple(w[p: p + window])
            first[key] = min(first.get(key, (at(i), p)), (at(i), p))
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p: p + window])] < (at(i), p):
                gone[p: p + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(map(repr, out))


def check_repeats(df, window=20, limit=4096):
    got = substrings.remove_repeats(df, window, limit).collect()
    seen = sorted(repr((r.doc_id, r.n_words, r.n_removed, b" ".join((r.text or "").encode().split()).decode())) for r in got)
    assert seen == brute_repeats([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], window)


@pytest.mark.parametrize("limit", [1, 4096])
def test_repeats_table(spark, limit):
    check_repeats(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), limit=limit)


@pytest.mark.parametrize("wrap", [lambda d: d, clashing])
def test_repeats_odd_rows(spark, wrap):
    check_repeats(wrap(documents(spark, ODD)))
    assert substrings.remove_repeats(documents(spark, [])).count() == 0


@pytest.mark.parametrize("window", [3, 7, 20])
def test_repeats_in_periodic_and_random_texts(spark, window):
    import random
    rnd = random.Random(window)
    rows = [(i, " ".join(rnd.choice("ab" if i % 2 else "abcdefgh") for _ in range(rnd.randint(0, 120))), "en", "s") for i in range(60)]
    rows += [(100, "a " * 200, "en", "s"), (101, "a b " * 90, "en", "s"), (102, "a b c " * 60, "en", "s")]
    check_repeats(documents(spark, rows), window, limit=3)


def test_deduplicated_keeps_rows_columns_and_white_space(spark):
    docs = documents(spark, ODD)
    out = substrings.deduplicated(clashing(docs))
    assert out.columns == clashing(docs).columns and out.count() == len(ODD)
    texts = {r.doc_id: r for r in out.collect()}
    assert texts[4].text == f"before {PASSAGE} after" and texts[5].text == "other words" and texts[5].n_chars == 11
    assert texts[7].text == LONG and texts[1].text is None and texts[9].text == ""
    assert rows_of(out.where("doc_id = 6"), ["text", "score"]) == rows_of(clashing(docs).where("doc_id = 6"), ["text", "score"])


def test_query_digest(spark):
    got = substrings.op3_substring_dedup(spark, SF_SMALL)
    import hashlib
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = {eval(r)[0]: eval(r) for r in brute_repeats([tuple(r) for r in docs], 20)}
    for r in got.select("doc_id", "n_words", "n_removed", F.col("kept_sha256")).collect():
        i, n, gone, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_word_hashes_do_not_depend_on_earlier_words():
    """A word hashes alike whether or not longer words were hashed before it."""
    import subprocess
    import sys

    import pyarrow as pa
    from shelfcast.llm.common import split_words, word_hashes
    word_hashes(split_words(pa.array(["w" * 500])))
    code = "import pyarrow as pa; from shelfcast.llm.common import *; print(word_hashes(split_words(pa.array(['a b c']))).tolist())"
    alone = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout
    assert alone.strip() == str(word_hashes(split_words(pa.array(["a b c"]))).tolist())
