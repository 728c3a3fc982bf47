"""SimHash near-duplicates by pivot distance tables (operator 8).

A document's fingerprint has a bit set where over half of the XXH64 hashes of
its word shingles have it set.  Two fingerprints link when they differ in at
most ``max_distance`` bits; a component is everything reachable over links.

Finding the links is exact and runs on distinct fingerprints only:

* Equal copies are folded first (a partial aggregate), so a group of copies of
  any size counts once.
* With at most ``k`` differing bits, at least one of ``k + 1`` blocks of bits
  is the same, so a fingerprint is filed under each of its blocks.  A block
  value with too many members is filed again under blocks of its remaining
  bits (the same argument holds there), and again under the bits then left;
  what is still too large is dealt out as pairs of parts, so no task ever holds a large group.
* Within a group the table of Hamming distances to reference fingerprints
  (pivots) decides: by the triangle inequality two fingerprints within ``k``
  bits have no coordinate more than ``k`` apart.  The group is sorted by its
  first coordinate, which bounds the band that is looked at; the others
  discard pairs; survivors are verified by their exact distance.
* A group reports a spanning forest of its links, not its pairs.

Components come from rounds of large-star / small-star, each written to the
shared folder.  A component is named in parts, so a very large one is in no single task.

Edge cases: a null or empty text has fingerprint 0; fewer words than the
shingle length give one shingle of all words; repeated rows each return a row;
null ids are kept and count last when a component's smallest id is taken (a
component of null ids only has a null id); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from shelfcast.llm.common import fresh, map_arrow, read_table, slices, staged

PIVOTS = 8
GROUP_LIMIT = 4096
LEVELS = 3             # a group of the last level shares about 31 bits
CLASS_PARTS = 64
_RNG = np.random.default_rng(20)
PIVOT_VALUES = _RNG.integers(0, 2**64, size=PIVOTS, dtype=np.uint64)


def simhash(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Fingerprint of one text as an unsigned 64-bit integer."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, seed)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - shingle]]
    hashes = np.fromiter((xxh64_intdigest(joined[a: b - 1], seed) for a, b in zip(starts, ends[shingle - 1:])),
                         dtype="<u8", count=len(starts))
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at: at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, fp): the SimHash of every text as a signed long."""
    source = docs.select("doc_id", *keep, "text")
    carried = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values = [simhash((t or "").encode(), shingle, seed) for t in part.column("text").to_pylist()]
                fp = np.array(values, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carried], pa.array(fp)], names=[*carried, "fp"])

    fields = [f"{c} {source.schema[c].dataType.simpleString()}" for c in carried]
    return map_arrow(source, run, ", ".join([*fields, "fp long"]))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _blocks(bits: list[int], count: int) -> list[int]:
    """Masks of ``count`` nearly equal parts of the given bit positions."""
    parts = [bits[i * len(bits) // count: (i + 1) * len(bits) // count] for i in range(count)]
    return [sum(1 << b for b in p) for p in parts]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _filed(fps: DataFrame, max_distance: int, limit: int, levels: int = LEVELS) -> DataFrame:
    """(key, fp, side): every fingerprint under its groups; only one side's pairs with the other count where both occur.

    Two fingerprints that link differ in at most ``max_distance`` bits, so they agree in one of ``max_distance + 1`` blocks of any set of
    bits.  Groups over ``limit`` are filed again under blocks of the bits they have not compared yet, ``levels`` times in all; what is
    still too large then is dealt to parts that meet pairwise.
    """
    count = max_distance + 1
    rests = [list(range(64))]      # per path of blocks taken so far: the bits left
    rows = fps.select("fp", F.lit(0).alias("path"), F.lit(0).cast("long").alias("key"))
    filed = None
    for _ in range(levels):
        masks = [_blocks(bits, count) for bits in rests]
        table = F.array(*[F.array(*[F.lit(_signed(m)) for m in ms]) for ms in masks])
        rows = (rows.select("fp", "path", "key", F.posexplode(F.element_at(table, F.col("path") + 1)).alias("block", "mask"))
                .select("fp", (F.col("path") * count + F.col("block")).alias("path"), "key", F.col("fp").bitwiseAND(F.col("mask")).alias("value"))
                .select("fp", "path", F.xxhash64("key", "path", "value").alias("key")))
        rests = [[b for b in bits if not m >> b & 1] for bits, ms in zip(rests, masks) for m in ms]
        hot = rows.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > limit)
        marked = rows.join(hot, "key", "left")
        done = marked.where("m is null").select("key", "fp", F.lit(0).alias("side"))
        filed = done if filed is None else filed.unionByName(done)
        rows = staged(marked.where("m is not null"), "hot-blocks")
        if rows.isEmpty():
            return filed
        large, rows = rows, rows.drop("m")
    dealt = large.withColumn("parts", F.ceil(F.col("m") / F.lit(limit)).cast("long"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts"))
    dealt = dealt.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    a, b = F.least("part", "other"), F.greatest("part", "other")
    return filed.unionByName(dealt.select(F.xxhash64("key", a, b).alias("key"), "fp",
                                          F.when(a == b, 0).otherwise(F.when(F.col("part") == a, 1).otherwise(2)).alias("side")))


def group_links(key: np.ndarray, fp: np.ndarray, side: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (u, v) of the groups of equal ``key``: pivot table, band, coordinate filter, exact distance."""
    table = np.bitwise_count(fp[:, None] ^ PIVOT_VALUES[None, :]).astype(np.int16)
    order = np.lexsort((table[:, 0], key))
    key, fp, side, table = key[order], fp[order], side[order], table[order]
    n, label, shift = len(fp), np.arange(len(fp)), 0
    left = np.arange(n)
    us, vs = [], []
    while len(left):
        shift += 1
        left = left[left + shift < n]
        right = left + shift
        near = (key[right] == key[left]) & (table[right, 0] - table[left, 0] <= max_distance)
        left, right = left[near], right[near]
        # sides 1 and 2 are two parts of one large group: pairs within a part are met elsewhere
        keep = (label[left] != label[right]) & ((side[left] == 0) | (side[left] != side[right]))
        i, j = left[keep], right[keep]
        for p in range(1, PIVOTS):
            close = np.abs(table[i, p] - table[j, p]) <= max_distance
            i, j = i[close], j[close]
        found = np.bitwise_count(fp[i] ^ fp[j]) <= max_distance
        i, j = i[found], j[found]
        if len(i):
            us.append(fp[i])
            vs.append(fp[j])
            while True:  # union by smallest label
                a, b = label[i], label[j]
                if (a == b).all():
                    break
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while (label[label] != label).any():
                    label = label[label]
    if not us:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(us), np.concatenate(vs)


def links(fps: DataFrame, max_distance: int = 4, limit: int = GROUP_LIMIT) -> DataFrame:
    """(u, v) links between distinct fingerprints that span every component."""
    filed = _filed(fps.select("fp"), max_distance, limit)
    ordered = filed.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(block: pa.Table) -> pa.RecordBatch:
            cols = [block.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("key", "fp", "side")]
            u, v = group_links(cols[0], cols[1].view(np.uint64), cols[2], max_distance)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = batch.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
            if cut == 0:   # one group so far, with a bounded number of members
                held.append(batch)
                continue
            yield emit(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        if held:
            yield emit(pa.Table.from_batches(held))

    return map_arrow(ordered, run, "u long, v long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links: large-star and small-star until nothing changes.

    ``root`` is the component's smallest node.  Both steps are group minima
    (partial aggregates) joined back, so a node with very many links is
    split like any skewed join.
    """
    pairs = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = staged(pairs, "links")
    before = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where("u != v").distinct())
        pairs = staged(small, "links")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_distance: int = 4, seed: int = 42,
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, fp, component_id, _class): one row per row of ``docs``.

    ``_class`` is the smallest fingerprint of the component.
    """
    rows = staged(fingerprints(docs, shingle, seed, keep), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = staged(components(links(distinct, max_distance)), "roots")
    # a component may hold a third of all fingerprints: named in parts, its smallest id found over the parts
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("_class"), F.pmod(F.xxhash64("fp"), F.lit(CLASS_PARTS)).alias("part"))
    parts = placed.groupBy("_class", "part").agg(F.min("rep").alias("least"))
    smallest = parts.withColumn("component_id", F.min("least").over(Window.partitionBy("_class"))).drop("least")
    named = staged(placed.join(smallest, ["_class", "part"]).select("fp", "_class", "component_id"), "components")
    return rows.join(named, "fp").select("doc_id", *keep, "fp", "component_id", "_class")


def keep_one(docs: DataFrame, shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """One row of ``docs`` per component: the smallest id (null last), then the smallest text hash."""
    tagged = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    found = near_duplicates(tagged, shingle, max_distance, keep=("h",))
    first = found.groupBy("_class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("k"))
    h, r, own_id, own_h = fresh(docs, "h", "r", "own_id", "own_h")
    first = first.select(F.col("k.doc_id").alias(own_id), F.col("k.h").alias(own_h))
    rows = docs.withColumn(h, F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(first[own_id]) & (rows[h] == first[own_h])
    once = Window.partitionBy("doc_id", h).orderBy(h)
    return (rows.join(first, same, "left_semi").withColumn(r, F.row_number().over(once))
            .where(F.col(r) == 1).select(docs.columns))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")
