"""Removal of word passages that occur earlier in the corpus (operator 3).

A window is ``window`` consecutive words of one document.  A word goes if it
is covered by a window whose word sequence also starts earlier (smaller id, or
the same document at an earlier word).  Windows are judged on the input.

Minimiser routing and groups of equal hashes stand in for suffix trees: whether a
window occurs earlier only asks for equal windows, not for their order.

* Equal windows share the smallest hash among their ``STEM``-word pieces, and
  neighbouring windows mostly share it too, so that piece, the *stem*, names the group and one row
  carries a whole run of neighbouring windows.
* Stems are counted over the whole corpus.  Windows under a stem that occurs once are dropped; only those
  under repeated stems travel.
* A stem with more than ``GROUP_LIMIT`` occurrences is too large for one
  group: its windows are routed one by one by their full hash and a part number, as many parts as keep each group
  under the limit.  Each part's first window goes on to a second round, where the parts of one
  window meet; all others in a part are repeats already.
* In a group the windows are sorted by hash, id and position.  Of those
  with equal hashes all but the first start a repeat.  Neighbouring repeats join to maximal ones.

A map task folds equal windows of its slice before anything is shuffled, so a
passage that a third of all documents share sends one row per slice.  Rows are told apart by id and a
hash of id and text, so documents with different ids never share a key.

Windows are compared by 96 bits of two independent hashes.

Edge cases: a null text has no words and stays null; texts without a repeat
are returned unchanged, from others each removed word goes with the white
space after it; rows with the same id count as one document (an equal window
at the same position of such rows is not earlier); a null id sorts first; ids
are integers; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.common import Words, map_arrow, mix, read_table, slices, split_words, staged, word_hashes

WINDOW = 20
STEM = 6
GROUP_LIMIT = 4096
_ENTRY = np.dtype([("h", "<u8"), ("h2", "<u4")])
_RANGE = np.dtype([("start", "<i4"), ("end", "<i4")])
_FACTORS = (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1342543DE82EF95))


def _rolling(values: np.ndarray, size: int, factor: np.uint64) -> np.ndarray:
    """Mixed polynomial hash of every ``size`` consecutive values."""
    n = len(values) - size + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(size if n > 0 else 0):
        out = out * factor + values[j: j + n]
    return mix(out)


class Windows:
    """All windows of the texts of a slice: text number, position, stem, stem position."""

    def __init__(self, words: Words, window: int):
        self.hashes, self.size = word_hashes(words), window
        n = max(len(self.hashes) - window + 1, 0)
        text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))[:n]
        stem = min(STEM, window)
        pieces = _rolling(self.hashes, stem, _FACTORS[0])
        best, at = pieces[:n].copy(), np.zeros(n, dtype=np.int64)
        for j in range(1, window - stem + 1):
            other = pieces[j: j + n]
            at[other < best] = j
            np.minimum(best, other, out=best)
        index = np.arange(n)
        whole = index + window <= words.first[1:][text] if n else np.zeros(0, dtype=bool)
        self.index, self.text, self.stem = index[whole], text[whole], best[whole]
        self.position = self.index - words.first[:-1][self.text]
        at = (index + at)[whole]
        self.run = np.flatnonzero(np.diff(at, prepend=-1) != 0)  # first window of each occurrence of a stem

    def prefixes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = self.index[which]
        return (_rolling(self.hashes, self.size, _FACTORS[1])[i],
                (_rolling(self.hashes, self.size, _FACTORS[2])[i] >> np.uint64(32)).astype(np.uint32))


def _first_of_equal(columns: list[np.ndarray], ties: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, head): rows sorted by columns then ties; head[k] is the sorted place of the first row equal to row k in columns."""
    order = np.lexsort([*reversed(ties), *reversed(columns)])
    new = np.zeros(len(order), dtype=bool)
    if len(order):
        new[0] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


def _ranges(owner: np.ndarray, position: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(owner, packed start/end pairs) for window positions sorted by owner and position."""
    if not len(owner):
        return
    cut = np.flatnonzero((np.diff(owner) != 0) | (np.diff(position) != 1)) + 1
    heads = np.concatenate(([0], cut))
    pairs = np.zeros(len(heads), dtype=_RANGE)
    pairs["start"] = position[heads]
    pairs["end"] = position[np.concatenate((cut, [len(position)])) - 1] + 1
    who = owner[heads]
    edges = np.concatenate(([0], np.flatnonzero(np.diff(who) != 0) + 1, [len(who)]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(who[a]), pairs[a:b].tobytes()


def _texts(packed: pa.Array) -> pa.Array:
    inflate = zstandard.ZstdDecompressor().decompress
    return pa.array([inflate(z) if z is not None else None for z in packed.to_pylist()], type=pa.binary())


def _row_key() -> list[Column]:
    """``id`` (a missing one is the smallest number) and ``rk``, a hash of id and text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("id"), F.xxhash64("doc_id", "text").alias("rk")]


def pack(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(id, rk, doc_id, z, k0, k1, ...): the two parts of a row's key, the id, the compressed text that both joins shuffle, and the kept columns."""
    names = [f"k{i}" for i in range(len(keep))]
    source = docs.select(*_row_key(), F.col("doc_id").cast("long").alias("doc_id"), "text",
                         *[F.col(c).alias(n) for c, n in zip(keep, names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deflate = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in slices(batch):
                z = [deflate(t.encode()) if t is not None else None for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("rk"), part.column("doc_id"), pa.array(z, pa.binary()), *[part.column(n) for n in names]],
                    names=["id", "rk", "doc_id", "z", *names])

    return map_arrow(source, run, ", ".join(["id long not null", "rk long not null", "doc_id long", "z binary",
                                             *[f"{n} {source.schema[n].dataType.simpleString()}" for n in names]]))


def _stems(docs: DataFrame, window: int, per_row: bool) -> DataFrame:
    """Per slice (stem, n), or per row of ``docs`` (id, rk, stem)."""
    source = docs.select(*_row_key(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Windows(split_words(part.column("text")), window)
                stem = w.stem[w.run]
                if per_row:
                    text = w.text[w.run]
                    order, head = _first_of_equal([text, stem], [])
                    once = order[head == np.arange(len(head))]
                    key = [pa.array(part.column(c).to_numpy()[text[once]]) for c in ("id", "rk")]
                    yield pa.RecordBatch.from_arrays([*key, pa.array(stem[once].view(np.int64))], names=["id", "rk", "stem"])
                else:
                    values, counts = np.unique(stem, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))],
                                                     names=["stem", "n"])

    return map_arrow(source, run, "id long, rk long, stem long" if per_row else "stem long, n long")


_SUFFIX = "key long, id long, pos int, rk long, blob binary, hot boolean"


def _suffixes(found: DataFrame, window: int) -> DataFrame:
    """(key, id, pos, rk, blob, hot): runs of windows under repeated stems; ``pos`` -1 marks repeats already proven in a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "z", 1 << 20):
                w = Windows(split_words(_texts(part.column("z"))), window)
                lists = part.column("stems")
                stems = lists.flatten()
                owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                salt = np.uint64(0xC2B2AE3D27D4EB4F)
                known = mix(stems.field("stem").to_numpy().view(np.uint64) + owner.astype(np.uint64) * salt)
                order = np.argsort(known)
                known, parts = known[order], stems.field("parts").to_numpy()[order]
                mine = mix(w.stem + w.text.astype(np.uint64) * salt)
                place = np.minimum(np.searchsorted(known, mine), max(len(known) - 1, 0))
                which = np.flatnonzero(known[place] == mine) if len(known) else np.empty(0, np.int64)
                h, h2 = w.prefixes(which)
                text, pos, stem, parts = w.text[which], w.position[which], w.stem[which], parts[place[which]]
                rk = part.column("rk").to_numpy()
                doc = part.column("id").to_numpy()
                order, head = _first_of_equal([h, h2], [doc[text], pos])
                first = order[head]
                later = (doc[text[order]] != doc[text[first]]) | (pos[order] != pos[first])
                proven = order[later]
                proven = proven[np.lexsort((pos[proven], text[proven]))]
                ship = np.sort(order[head == np.arange(len(head))])
                columns: list[list] = [[], [], [], [], [], []]
                for t, blob in _ranges(text[proven], pos[proven]):
                    for c, x in zip(columns, (int(rk[t]), int(doc[t]), -1, int(rk[t]), blob, False)):
                        c.append(x)
                entries = np.zeros(len(ship), dtype=_ENTRY)
                entries["h"], entries["h2"] = h[ship], h2[ship]
                if len(ship):
                    s_parts, s_text, s_pos, s_stem = parts[ship], text[ship], pos[ship], stem[ship]
                    s_hot = s_parts > 1
                    new = np.concatenate(([True], s_hot[1:] | s_hot[:-1] | (np.diff(s_text) != 0) | (np.diff(s_pos) != 1)
                                          | (s_stem[1:] != s_stem[:-1])))
                    at = np.flatnonzero(new)
                    row = mix(rk[s_text[at]].view(np.uint64) + s_pos[at].astype(np.uint64) * salt)
                    dealt = mix(h[ship][at] + (row % s_parts[at].astype(np.uint64)) * salt)     # a part of the window's group
                    key = np.where(s_hot[at], dealt, s_stem[at]).view(np.int64)
                    ends = np.concatenate((at[1:], [len(ship)]))
                    columns[0] += key.tolist()
                    columns[1] += doc[s_text[at]].tolist()
                    columns[2] += s_pos[at].tolist()
                    columns[3] += rk[s_text[at]].tolist()
                    columns[4] += [entries[a:b].tobytes() for a, b in zip(at.tolist(), ends.tolist())]
                    columns[5] += s_hot[at].tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()),
                     pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.binary()), pa.array(columns[5], pa.bool_())],
                    names=["key", "id", "pos", "rk", "blob", "hot"])

    return map_arrow(found, run, _SUFFIX)


def _grouped(suffixes: DataFrame) -> DataFrame:
    """One round: repeats as (id, rk, blob of packed ranges, ``pos`` -1), and the first windows of hot groups, keyed by their whole hash."""
    ordered = suffixes.repartition("key").sortWithinPartitions("key")

    def groups(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        pos, hot = t.column("pos").to_numpy(), t.column("hot").to_numpy()
        rk, ids, blobs = t.column("rk").to_numpy(), t.column("id").to_numpy(), t.column("blob").to_pylist()
        done = np.flatnonzero(pos < 0)
        out = [(int(rk[r]), int(ids[r]), -1, int(rk[r]), blobs[r], False) for r in done.tolist()]
        rows = np.flatnonzero(pos >= 0)
        if len(rows):
            entries = np.frombuffer(b"".join([blobs[r] for r in rows.tolist()]), dtype=_ENTRY)
            sizes = np.array([len(blobs[r]) // _ENTRY.itemsize for r in rows.tolist()])
            heads = np.cumsum(sizes) - sizes
            row = np.repeat(rows, sizes)
            start = pos[row] + (np.arange(len(entries)) - np.repeat(heads, sizes))
            key, doc = t.column("key").to_numpy()[row], ids[row]
            order, head = _first_of_equal([key, entries["h"], entries["h2"]], [doc, start])
            first = order[head]
            later = order[(doc[order] != doc[first]) | (start[order] != start[first])]
            later = later[np.lexsort((start[later], rk[row[later]], doc[later]))]
            own = row[later]
            owner = np.cumsum((np.diff(rk[own], prepend=rk[own[:1]]) != 0) | (np.diff(ids[own], prepend=ids[own[:1]]) != 0))
            names = own[np.searchsorted(owner, np.arange(owner[-1] + 1))] if len(own) else own
            for o, blob in _ranges(owner, start[later]):
                r = names[o]
                out.append((int(rk[r]), int(ids[r]), -1, int(rk[r]), blob, False))
            for e in order[head == np.arange(len(head))].tolist():
                if hot[row[e]]:
                    r = row[e]
                    out.append((int(entries["h"][e].view(np.int64)), int(ids[r]), int(start[e]), int(rk[r]), entries[e].tobytes(), False))
        columns = list(zip(*out)) if out else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "id", "pos", "rk", "blob", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = batch.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
            if cut == 0:    # one group so far; its size is bounded
                held.append(batch)
                continue
            yield groups(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        if held:
            yield groups(pa.Table.from_batches(held))

    return map_arrow(ordered, run, _SUFFIX)


def _repeats(suffixes: DataFrame) -> DataFrame:
    """(id, rk, blob): packed ranges of window starts that are repeats of an earlier window."""
    found = staged(_grouped(suffixes), "repeats")
    second = _grouped(found.where("pos >= 0"))      # the parts of hot windows meet, one window each
    return found.where("pos < 0").unionByName(second).select("id", "rk", "blob")


def _cut(marked: DataFrame, window: int) -> DataFrame:
    """Remove the covered words of each text; kept columns stay."""
    kept_names = [c for c in marked.columns if c not in ("id", "rk", "doc_id", "z", "blobs")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "z", 1 << 20):
                texts = _texts(part.column("z"))
                words = split_words(texts)
                n = len(words.starts)
                change = np.zeros(n + 1, dtype=np.int64)
                for i, blobs in enumerate(part.column("blobs").to_pylist()):
                    if blobs:
                        pairs = np.frombuffer(b"".join(blobs), dtype=_RANGE)
                        np.add.at(change, words.first[i] + pairs["start"], 1)
                        np.add.at(change, words.first[i] + pairs["end"] + (window - 1), -1)
                gone = np.cumsum(change)[:n] > 0
                # a removed word goes with what follows it, up to the next word or the end of the text
                text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
                after = np.minimum(np.append(words.starts[1:], len(words.data)), words.offsets[1:][text]) if n else words.starts
                byte = np.zeros(len(words.data) + 1, dtype=np.int32)
                np.add.at(byte, words.starts[gone], 1)
                np.add.at(byte, after[gone], -1)
                keep = np.cumsum(byte)[:-1] == 0
                kept = np.concatenate(([0], np.cumsum(keep)))[words.offsets]
                data = words.data[keep].tobytes()
                valid = part.column("z").is_valid().to_pylist()
                out = [data[a:b].decode() if v else None for a, b, v in zip(kept[:-1].tolist(), kept[1:].tolist(), valid)]
                removed = np.concatenate(([0], np.cumsum(gone)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(out, pa.string()), pa.array(np.diff(words.first)),
                     pa.array(np.diff(removed[words.first])), *[part.column(c) for c in kept_names]],
                    names=["doc_id", "text", "n_words", "n_removed", *kept_names])

    return map_arrow(marked, run, ", ".join(["doc_id long", "text string", "n_words long", "n_removed long",
                                             *[f"{c} {marked.schema[c].dataType.simpleString()}" for c in kept_names]]))


def remove_repeats(docs: DataFrame, window: int = WINDOW, limit: int = GROUP_LIMIT, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, text, n_words, n_removed, k0, k1, ...) for every row of ``docs``; ``text`` without repeated passages.

    ``k0, k1, ...`` are the columns named by ``keep``.
    """
    packed = pack(docs, keep or [])
    repeated = (_stems(docs, window, per_row=False).groupBy("stem").agg(F.sum("n").alias("n")).where("n > 1")
                .select("stem", F.when(F.col("n") > limit, F.ceil(F.col("n") / limit)).otherwise(1).cast("long").alias("parts")))
    per_row = _stems(docs, window, per_row=True).join(repeated, "stem")
    candidates = per_row.groupBy("id", "rk").agg(F.collect_set(F.struct("stem", "parts")).alias("stems"))
    found = packed.join(candidates, ["id", "rk"]).select("id", "rk", "z", "stems")
    blobs = _repeats(_suffixes(found, window)).groupBy("id", "rk").agg(F.collect_set("blob").alias("blobs"))
    return _cut(packed.join(blobs, ["id", "rk"], "left"), window)


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages cut from ``text`` and ``n_chars`` set to the new length; all rows stay."""
    keep = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = remove_repeats(docs, window, keep=keep)
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long"),
           **{c: F.col(f"k{i}") for i, c in enumerate(keep)}}
    return cut.select([own[c].alias(c) for c in docs.columns])


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(read_table(spark, sf_dir, "documents"))
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.encode(kept, "UTF-8"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT r, doc_id, range(1, len(w) - 18) AS starts, [md5(array_to_string(w[i:i + 19], ' ')) FOR i IN range(1, len(w) - 18)] AS hs FROM d WHERE len(w) >= 20),
x AS (SELECT r, doc_id, unnest(starts) AS s, unnest(hs) AS h FROM v),
f AS (SELECT h, min({'id': doc_id, 's': s}) AS lowest FROM x GROUP BY h),
c AS (SELECT DISTINCT r, unnest(range(s, s + 20)) AS p FROM x JOIN f USING (h) WHERE {'id': doc_id, 's': s} > lowest),
u AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS kept FROM u ANTI JOIN c USING (r, p) GROUP BY r),
n AS (SELECT r, count(*) AS n_removed FROM c GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)
"""
