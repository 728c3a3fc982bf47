"""Ranked lexical search by pipelined term partitioning (operator 13).

A query set of items is ranked against all documents with integer scores:

1. One pass over the documents writes *blocks* of a bounded number of
   neighbouring documents: their sizes and, sorted by term, the postings
   (document, frequency) of the items' terms.  N, L and the document
   frequencies are aggregates over the blocks.
2. Terms are dealt to *owners* by rising document frequency, each owner with
   an equal share of the postings, so accumulators stay sparse until the end.
3. Bundles, one per (item, block), carry sparse accumulators (documents,
   scores so far) from owner to owner: each stage cogroups the bundles of a
   block with the postings that its owner holds there, adds the integer
   contributions and passes the bundles on.  Sums of integers do not depend on
   the order of the stages.
4. The last owner keeps the best of each bundle, two top-k windows the best of
   each item.  No accumulator is dropped before.

A task holds one block at a time; an item's accumulators are spread over all
blocks, so no item and no frequent term gathers in one place.  The query set
goes through in batches of at most ``BATCH_TERMS`` (item, term) pairs, which
are the only thing shipped to every worker.

Edge cases: a null or empty text has no term, such a document counts nowhere
and such an item has no result; repeated documents rank one after the other
in the order of the scan, null ids after all others; every row of the query set
is an item of its own; empty tables give an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import map_arrow, read_table, slices, staged

TOP = 20
OWNERS = 4              # term-owner stages
BATCH_TERMS = 200_000   # (item, term) pairs that go through together
BLOCK_BYTES = 4 << 20
BLOCK_DOCS = 4096
CHUNK = 1 << 20         # a text is split into words in parts of this size
SCALE, BASE, LENGTH = 1_000_000_000, 75, 25
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def count_terms(text: bytes) -> Counter:
    """Terms of a text: runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    found, at, text = Counter(), 0, text.translate(_FOLD)
    while at < len(text):
        end = text.find(b" ", at + CHUNK)
        end = len(text) if end < 0 else end
        found.update(text[at:end].split())
        at = end
    return found


def item_terms(items: DataFrame) -> DataFrame:
    """(row, item_id, terms, times) of every row of the query set that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [count_terms((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("item_id"), pa.array([list(c) for c in counts], pa.list_(pa.binary())),
                 pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))], ["row", "item_id", "terms", "times"])

    rows = items.select(F.monotonically_increasing_id().alias("row"), "item_id", "text")
    return map_arrow(rows, run, "row long, item_id long, terms array<binary>, times array<long>").where(F.size("terms") > 0)


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """One row per block: ids and sizes of its documents, and the postings of the vocabulary, sorted by term code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, limit=BLOCK_BYTES):
                for at in range(0, part.num_rows, BLOCK_DOCS):
                    rows = part.slice(at, BLOCK_DOCS)
                    sizes, codes, docs_, times = [], [], [], []
                    for d, text in enumerate(rows.column("text").cast(pa.large_binary())):
                        found = count_terms(text.as_py() or b"")
                        sizes.append(found.total())
                        hits = found.keys() & vocabulary.keys()
                        codes += [vocabulary[t] for t in hits]
                        times += [found[t] for t in hits]
                        docs_ += [d] * len(hits)
                    code = np.array(codes, np.int32)
                    order = np.argsort(code, kind="stable")
                    held, counts = np.unique(code, return_counts=True)
                    ids = rows.column("doc_id")
                    yield pa.RecordBatch.from_arrays([
                        pa.array([block]), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([np.array(sizes, "<i8").tobytes()], pa.binary()),
                        pa.array([int(np.count_nonzero(sizes))]), pa.array([sum(sizes)]),
                        pa.array([held.tolist()], pa.list_(pa.int32())), pa.array([counts.tolist()], pa.list_(pa.int32())),
                        pa.array([np.array(docs_, "<u2")[order].tobytes()], pa.binary()),
                        pa.array([np.array(times, "<i8")[order].tobytes()], pa.binary())],
                        ["block", "ids", "sizes", "n_docs", "n_terms", "codes", "counts", "docs", "times"])
                    block += 1

    return map_arrow(docs.select("doc_id", "text"), run, "block long, ids array<long>, sizes binary, n_docs long, n_terms long, "
                     "codes array<int>, counts array<int>, docs binary, times binary")


def _owned(blocks: DataFrame, owner: np.ndarray, stage: int, n_docs: int, n_terms: int, last: bool) -> DataFrame:
    """The postings of one owner per block, frequencies turned into contributions before the weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes, counts = np.array(row["codes"], np.int32), np.array(row["counts"], np.int64)
                mine = owner[codes] == stage
                wanted = np.repeat(mine, counts)
                docs = np.frombuffer(row["docs"], "<u2")[wanted]
                times = np.frombuffer(row["times"], "<i8")[wanted]
                sizes = np.frombuffer(row["sizes"], "<i8")
                m = BASE + (LENGTH * sizes * n_docs) // n_terms
                part = (SCALE * times) // (1000 * times + 12 * m[docs])
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["block"]]), pa.array([len(sizes)]), pa.array([row["ids"] if last else None], pa.list_(pa.int64())),
                    pa.array([codes[mine].tobytes()], pa.binary()), pa.array([counts[mine].astype("<u2").tobytes()], pa.binary()),
                    pa.array([docs.tobytes()], pa.binary()), pa.array([part.astype("<u4").tobytes()], pa.binary())],
                    ["block", "size", "ids", "codes", "counts", "docs", "parts"])

    used = blocks if last else blocks.drop("ids")
    return map_arrow(used, run, "block long, size long, ids array<long>, codes binary, counts binary, docs binary, parts binary")


_BUNDLE = "block long, item int, docs binary, scores binary"
_BEST = "item int, doc_id long, score long, block long, place int"


def _added(bundles: DataFrame, owned: DataFrame, wanted: list[tuple[int, np.ndarray, np.ndarray]], top: int | None) -> DataFrame:
    """One owner's stage; ``wanted`` lists (item, its codes here, weight times repeats).  With ``top`` the best of each bundle."""

    def run(key, left, right):
        held = right.to_pylist()[0]
        codes, counts = np.frombuffer(held["codes"], "<i4"), np.frombuffer(held["counts"], "<u2").astype(np.int64)
        docs, parts = np.frombuffer(held["docs"], "<u2"), np.frombuffer(held["parts"], "<u4").astype(np.int64)
        ends = np.cumsum(counts)
        before = {r["item"]: (np.frombuffer(r["docs"], "<u2"), np.frombuffer(r["scores"], "<i8")) for r in left.to_pylist()}
        here = {item: (c, w) for item, c, w in wanted}
        if top:     # null ids after all others
            ids = np.array([np.iinfo(np.int64).max if i is None else i for i in held["ids"]], np.int64)
            lacking = np.array([i is None for i in held["ids"]], bool)
        out = []
        for item in sorted(before.keys() | here.keys()):
            scores = np.zeros(held["size"], np.int64)
            if item in before:
                scores[before[item][0]] = before[item][1]
            if item in here and len(codes):
                c, w = here[item]
                at = np.searchsorted(codes, c)
                there = (at < len(codes)) & (codes[np.minimum(at, len(codes) - 1)] == c)
                for i, weight in zip(at[there].tolist(), w[there].tolist()):
                    span = slice(ends[i] - counts[i], ends[i])
                    scores[docs[span]] += weight * parts[span]      # a document occurs once in a term's postings
            found = np.flatnonzero(scores)
            if not len(found):
                continue
            if not top:
                out.append((key[0].as_py(), item, found.astype("<u2").tobytes(), scores[found].tobytes()))
                continue
            if len(found) > top:
                found = found[scores[found] >= np.partition(scores[found], -top)[-top]]
            found = found[np.lexsort((found, ids[found], lacking[found], -scores[found]))][:top]
            out += [(item, None if lacking[d] else int(ids[d]), int(scores[d]), key[0].as_py(), int(d)) for d in found.tolist()]
        columns = list(zip(*out)) or [[]] * (5 if top else 4)
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()] if top else [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        names = [f.split()[0] for f in (_BEST if top else _BUNDLE).split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return bundles.groupBy("block").cogroup(owned.groupBy("block")).applyInArrow(run, _BEST if top else _BUNDLE)


def _best(candidates: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of every item; partly by (item, share of the blocks) first, so no task sees all candidates of an item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "block", "place"]
    share = F.pmod(F.xxhash64("block"), F.lit(64))
    some = (candidates.withColumn("share", share).withColumn("k", F.row_number().over(Window.partitionBy("item", "share").orderBy(*order)))
            .where(F.col("k") <= top))
    return (some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
            .where(F.col("rank") <= top).select("item", "rank", "doc_id", "score"))


def _batches(terms: DataFrame, limit: int) -> Iterator[list]:
    """The query set in parts of about ``limit`` (item, term) pairs; an item is never parted."""
    total, largest = terms.agg(F.sum(F.size("terms")), F.max(F.size("terms"))).first()
    if not total:
        return
    parts = -(-total // limit)
    part = F.pmod(F.xxhash64("row"), F.lit(parts))
    while parts > 1 and terms.groupBy(part.alias("p")).agg(F.sum(F.size("terms")).alias("n")).agg(F.max("n")).first()[0] > 2 * limit + largest:
        parts *= 2
        part = F.pmod(F.xxhash64("row"), F.lit(parts))
    for k in range(parts):
        yield terms.where(part == k).collect()


def _search(docs: DataFrame, items: list, top: int, owners: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: k for k, t in enumerate(sorted({bytes(t) for r in items for t in r.terms}))}
    blocks = staged(_postings(docs, vocabulary), "ranked-blocks")
    n_docs, n_terms = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    pairs = blocks.select(F.explode(F.arrays_zip("codes", "counts")).alias("x"))
    df = np.zeros(len(vocabulary), np.int64)
    for r in pairs.groupBy("x.codes").agg(F.sum("x.counts").alias("n")).collect():      # one row per term of the batch
        df[r.codes] = r.n
    weight = np.array([math.floor(1000 * math.log((2 * (n_docs or 0) + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    rising = np.argsort(df, kind="stable")
    owner = np.empty(len(df), np.int32)
    owner[rising] = np.minimum((np.cumsum(df[rising]) - df[rising]) * owners // max(int(df.sum()), 1), owners - 1)
    needs = [(np.array([vocabulary[bytes(t)] for t in r.terms], np.int32), np.array(r.times, np.int64)) for r in items]
    bundles = spark.createDataFrame([], _BUNDLE)
    for stage in range(owners):
        last = stage == owners - 1
        wanted = []
        for item, (codes, times) in enumerate(needs):
            mine = (owner[codes] == stage) & (df[codes] > 0)
            if mine.any():
                wanted.append((item, codes[mine], times[mine] * weight[codes[mine]]))
        bundles = _added(bundles, _owned(blocks, owner, stage, n_docs or 0, max(n_terms or 0, 1), last), wanted, top if last else None)
    names = spark.createDataFrame([(k, r.row, r.item_id) for k, r in enumerate(items)], "item int, row long, item_id long")
    return _best(bundles, top).join(names, "item").select("row", "item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, owners: int = OWNERS, batch_terms: int = BATCH_TERMS) -> DataFrame:
    """The ``top`` documents (doc_id, text) of every item (item_id, text): row, item_id, rank, doc_id, score."""
    terms = staged(item_terms(items), "ranked-items")
    found = [_search(docs, batch, top, owners) for batch in _batches(terms, batch_terms)]
    empty = docs.sparkSession.createDataFrame([], "row long, item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found) if found else empty


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
p AS (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
f AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM p GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term, n_docs),
b AS (SELECT row_number() OVER () AS i, item_id,
             regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark),
t AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(terms) AS term FROM b) GROUP BY i, item_id, term),
x AS (SELECT i, item_id, r, any_value(doc_id) AS doc_id,
             sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM t JOIN w USING (term) JOIN f USING (term), s GROUP BY i, item_id, r),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM x WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 20
"""
