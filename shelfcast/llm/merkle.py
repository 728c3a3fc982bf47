"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces (operator 7).

A paragraph is a line of the text; it is cut into pieces at sentence ends (after
``PIECE`` characters otherwise; a paragraph of up to ``SHORT`` characters into words), the leaves.  A paragraph's hash covers its leaves'
hashes, a section's its paragraphs'; sections end at a blank line and at
paragraphs whose hash says so (one in ``SECTION``), so an edit moves no border
but its own.  The root covers the sections, the normal form of white space is not
touched: two texts have the same root exactly if they are the same (up to a
collision of hashes).

The fingerprint is the serialised tree ``root;section:paragraph(leaf.size,...)``,
so two fingerprints can be compared without their texts: equal roots end the
comparison, equal sections and paragraphs are matched whole, and only branches
that differ are opened.  Likeness is the share of characters in matched
branches, ``2 * matched / (chars a + chars b)``; ``differing`` lists the unmatched leaves with
their places.

``next document`` pairs neighbours in the order of (id, text hash) without a global sort: sampled
keys cut them into ranges, as many as the rows need; each
range's first document is also sent to the range before it, and each range is walked in order,
one document at a time.

Edge cases: a null text counts as empty; the empty text has a root of its own and
likeness 1 to itself, 0 to others; documents with the same id (or null ids, which
come first) follow each other by text hash; with one document it is its own
successor; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.common import map_arrow, read_table, slices, staged

PIECE = 160
SECTION = 8
RANGE_ROWS = (500, 50_000)   # fewest and most rows of a range, on average
_LEAF = re.compile(r"[^.!?…]{1,%d}[.!?…]*\s*|[.!?…]+\s*" % PIECE)
_WORD = re.compile(r"\s*\S+\s*|\s+")
SHORT = 120
_LINE = re.compile(r"[^\n]*\n|[^\n]+")


def _hash(data: bytes, size: int = 6) -> str:
    return hashlib.blake2b(data, digest_size=size).hexdigest()


#: section: (hash, chars, [(paragraph hash, chars, [(leaf hash, chars)])])
Tree = list[tuple[str, int, list[tuple[str, int, list[tuple[str, int]]]]]]


def tree(text: str) -> Tree:
    sections: Tree = []
    held: list = []

    def close() -> None:
        if held:
            sections.append((_hash("".join(p[0] for p in held).encode()), sum(p[1] for p in held), list(held)))
            held.clear()

    for line in _LINE.findall(text):
        leaves = [(_hash(p.encode()), len(p)) for p in (_LEAF if len(line) > SHORT else _WORD).findall(line)]
        name = _hash("".join(h for h, _ in leaves).encode())
        held.append((name, len(line), leaves))
        if not line.strip() or int(name[:8], 16) % SECTION == 0:
            close()
    close()
    return sections


def fingerprint(text: str) -> str:
    """Root and branches of a text's tree as one string."""
    sections = tree(text)
    root = _hash("".join(s[0] for s in sections).encode(), 16)
    body = "|".join(s[0] + ":" + ";".join(p[0] + "(" + ",".join(f"{h}.{n}" for h, n in p[2]) + ")" for p in s[2]) for s in sections)
    return f"{root}/{body}"


def parsed(value: str) -> tuple[str, Tree]:
    root, _, body = value.partition("/")
    sections: Tree = []
    for section in body.split("|") if body else []:
        name, _, rest = section.partition(":")
        paragraphs = []
        for p in rest.split(";"):
            h, _, inside = p.partition("(")
            leaves = [(a, int(n)) for a, n in (x.split(".") for x in inside[:-1].split(","))]
            paragraphs.append((h, sum(n for _, n in leaves), leaves))
        sections.append((name, sum(p[1] for p in paragraphs), paragraphs))
    return root, sections


def _unmatched(a: list, b: list) -> tuple[list, list, int]:
    """Nodes of a and of b left after equal hashes are paired off, and the characters of the pairs."""
    have = Counter(x[0] for x in b)
    rest_a, same = [], Counter()
    for x in a:
        if same[x[0]] < have[x[0]]:
            same[x[0]] += 1
        else:
            rest_a.append(x)
    left, rest_b, matched = Counter(same), [], 0
    for x in b:
        if left[x[0]]:
            left[x[0]] -= 1
            matched += x[1]
        else:
            rest_b.append(x)
    return rest_a, rest_b, matched


def likeness(a: str, b: str) -> float:
    """Share of characters in equal branches, from the two fingerprints alone."""
    if a[:32] == b[:32]:
        return 1.0
    (_, x), (_, y) = parsed(a), parsed(b)
    total = sum(s[1] for s in x) + sum(s[1] for s in y)
    x, y, matched = _unmatched(x, y)
    for _ in range(2):   # open differing sections, then differing paragraphs
        x, y, more = _unmatched([c for n in x for c in n[2]], [c for n in y for c in n[2]])
        matched += more
    return 2 * matched / total if total else 1.0


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(start, end) character ranges of the first text whose leaves the second lacks."""
    have = Counter(leaf[0] for s in parsed(b)[1] for p in s[2] for leaf in p[2])
    out, at = [], 0
    for s in parsed(a)[1]:
        for p in s[2]:
            for h, n in p[2]:
                if have[h]:
                    have[h] -= 1
                else:
                    out.append((at, at + n))
                at += n
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([fingerprint(t or "") for t in part.column("text").to_pylist()])],
                    names=["doc_id", "fingerprint"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, fingerprint string")


_KEY = np.dtype([("known", "i1"), ("id", "<i8"), ("th", "<i8")])    # a missing id comes first


def _keys_of(ids: pa.Array, hashes: pa.Array) -> np.ndarray:
    out = np.zeros(len(ids), _KEY)
    out["known"] = ids.is_valid().to_numpy(zero_copy_only=False)
    out["id"] = ids.fill_null(0).to_numpy()
    out["th"] = hashes.fill_null(0).to_numpy()
    return out


def _in_ranges(docs: DataFrame, rows: int | None) -> DataFrame:
    """(range, after, doc_id, th, text): every row in its range of keys, and each range's first key again (``after``) in the range before.

    One key in ``rows`` is a cut.  The cuts and the ranges' first keys (17 bytes each) are the only lists that all tasks get.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    keys = staged(source.select("doc_id", "th"), "neighbour-keys")
    if rows is None:
        low, high = RANGE_ROWS
        rows = max(low, min(high, keys.count() // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    picked = keys.where(F.pmod(F.xxhash64("doc_id", "th"), F.lit(rows)) == 0).distinct().toArrow()
    cuts = np.sort(_keys_of(picked.column("doc_id").combine_chunks(), picked.column("th").combine_chunks()))

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.sort(_keys_of(batch.column("doc_id"), batch.column("th")))
            place = np.searchsorted(cuts, own, side="right")
            head = np.flatnonzero(np.diff(place, prepend=-1) != 0)
            yield pa.RecordBatch.from_arrays([pa.array(place[head]), *[pa.array(own[f][head].astype(np.int64)) for f in _KEY.names]],
                                             names=["range", *_KEY.names])

    firsts = map_arrow(keys, lowest, "range long, known long, id long, th long").groupBy("range").agg(
        F.min(F.struct(*_KEY.names)).alias("first")).orderBy("range").collect()     # one row per range
    ranges = np.array([r["range"] for r in firsts], np.int64)
    heads = np.array([tuple(r["first"]) for r in firsts], _KEY)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                own = _keys_of(part.column("doc_id"), part.column("th"))
                at = np.searchsorted(cuts, own, side="right")
                which = np.searchsorted(ranges, at)
                first = np.flatnonzero(heads[which] == own)
                again = part.take(pa.array(first))
                for rows_, where, after in ((part, at, 0), (again, ranges[which[first] - 1], 1)):   # the first range comes after the last
                    yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int64)), pa.array(np.full(len(where), after, np.int32)),
                                                      *[rows_.column(c) for c in ("doc_id", "th", "text")]], names=names)

    names = ["range", "after", "doc_id", "th", "text"]
    return map_arrow(source, place, "range long, after int, doc_id long, th long, text string")


def with_next(docs: DataFrame, rows: int | None = None) -> DataFrame:
    """(doc_id, text, edited_text, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text has its last quarter replaced by as much of the next document's beginning.  ``rows`` is the average
    number of rows in a range (default: by the number of rows and shuffle partitions); it changes no result.
    """
    walked = _in_ranges(docs, rows).repartition("range").sortWithinPartitions("range", "after", "doc_id", "th")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None   # (range, doc_id, text, fingerprint) of the row before
        for batch in batches:
            for part in slices(batch):
                out: list[tuple] = []
                for where, after, doc, text in zip(*[part.column(c).to_pylist() for c in ("range", "after", "doc_id", "text")]):
                    text = text or ""
                    if after and (held is None or held[0] != where):
                        continue
                    print_ = fingerprint(text)
                    if held is not None and held[0] == where:
                        _, own_id, own, own_print = held
                        quarter = len(own) // 4
                        edited = own[: len(own) - quarter] + text[:quarter]
                        edited_print = fingerprint(edited)
                        out.append((own_id, own, edited, own_print, edited_print, likeness(own_print, edited_print),
                                    likeness(own_print, print_)))
                    held = None if after else (where, doc, text, print_)
                columns = list(zip(*out)) if out else [[]] * 7
                kinds = [pa.int64(), *[pa.string()] * 4, pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    names = ["doc_id", "text", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return map_arrow(walked, run, "doc_id long, text string, edited_text string, fingerprint string, edited_fingerprint string,"
                                  " near_edited double, near_next double")


def op7_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_next(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.length("text").cast("long").alias("n_chars"),
                        F.sha2(F.encode("edited_text", "UTF-8"), 256).alias("edited_sha256"),
                        "fingerprint", "edited_fingerprint", "near_edited", "near_next")
