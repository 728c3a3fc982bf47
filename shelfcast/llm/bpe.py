"""BPE encoding and decoding with a public vocabulary (operator 9).

Encoding equals the library's ``encode`` on the whole text, and decoding its
``decode``, but no text has to be encoded in one piece:

* The normaliser and the splitter of the vocabularies used here never join or
  see across white space, so a text is cut at ASCII white space, and pieces
  recur; each worker keeps a bounded cache of pieces and their ids.
* A text longer than ``LONG_TEXT`` characters is cut into spans (at white space where
  there is any) which are rows of their own, spread over the cluster, and put
  together again by id.
* Within a piece, a *unit* (what the splitter yields) longer than ``LEAF`` is the long
  unsplit text that one encoder call should not take whole.  It is encoded
  by tree concatenation: halves are encoded on their own, and a growing window
  around the join is encoded again until it contains, on either side, a whole
  token at the place where that side has it too.  A BPE sequence is the
  canonical one if all its neighbouring pairs are canonical, and every pair
  then lies in one of the three encodings, so the result is exact.

Edge cases: a null or empty text has no ids and decodes to the empty text;
special tokens' strings in a text become their ids, as in the library; repeated
rows each return a row; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfcast.llm.common import map_arrow, read_table, slices

VOCABULARY = "word_bpe_49k.json"
LEAF = 2048
LONG_TEXT = 1 << 20
CACHE = 50_000      # pieces; half as many words again: about 25 MB, which a worker keeps while other stages run
_MARKS = tuple(bytes([b]) for b in b".,:;!?|")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The printable letter that byte-level BPE uses for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


@lru_cache(maxsize=2)
def codec(path: str, leaf: int = LEAF) -> "Codec":
    """The worker's codec: workers are reused, so a vocabulary is loaded once and the cache outlives a task."""
    return Codec(path, leaf)


class Codec:
    """Encoder and decoder over one vocabulary file, for one worker."""

    def __init__(self, path: str, leaf: int = LEAF):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark runs one worker per core
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        if self.whole.decoder is not None:
            raise ValueError("decoding here joins tokens by a space: the vocabulary must have no decoder of its own")
        self.bare = Tokenizer(self.whole.model)           # the model alone: no normaliser, no splitter
        size = self.whole.get_vocab_size(with_added_tokens=True)
        self.token = [self.whole.id_to_token(i) or "" for i in range(size)]
        special = sorted((t.content for t in self.whole.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.suffix = len(self.whole.model.end_of_word_suffix or "")
        self.letters = _byte_letters()
        self.leaf = leaf
        self.cache: dict[bytes, bytes] = {}   # piece -> ids
        self.words: dict[str, bytes] = {}     # lower-case word -> ids

    def _lengths(self, ids: list[int]) -> list[int]:
        """Characters of the unit that each token covers (the unit's end mark has none)."""
        out = [len(self.token[i]) for i in ids]
        if out and self.suffix:
            out[-1] -= self.suffix
        return out

    def unit(self, text: str) -> list[int]:
        """Ids of one unit (text that the splitter leaves whole), by tree concatenation if it is long."""
        if len(text) <= self.leaf:
            return self.bare.encode(text, add_special_tokens=False).ids
        middle = len(text) // 2
        left, right = self.unit(text[:middle]), self.unit(text[middle:])
        return self.join(text, middle, left, right)

    def join(self, text: str, middle: int, left: list[int], right: list[int]) -> list[int]:
        """Ids of ``text`` from those of its two parts, through a window around the join that grows until both agree."""
        ends = np.cumsum([0, *self._lengths(left)])               # token boundaries of the left part
        starts = middle + np.cumsum([0, *self._lengths(right)])   # and of the right part
        reach = 8
        while True:
            a, b = max(len(left) - reach, 0), min(reach, len(right))
            lo, hi = int(ends[a]), int(starts[b])
            ids = self.bare.encode(text[lo:hi], add_special_tokens=False).ids if hi - lo <= 2 * self.leaf else self._window(text[lo:hi])
            at = lo + np.cumsum([0, *self._lengths(ids)])
            # a whole token that the window shares with the left part (its last token has an end mark: not counted) ...
            head = {(int(s), int(e)): k for k, (s, e) in enumerate(zip(at[:-1], at[1:]))}
            from_left = next((k for k in range(a, len(left) - 1) if (int(ends[k]), int(ends[k + 1])) in head
                              and ids[head[int(ends[k]), int(ends[k + 1])]] == left[k]), None)
            # ... and with the right part, whose last token may carry the end mark only where the window reaches the end
            last = b if b < len(right) else len(right)
            tail = [k for k in range(last) if (int(starts[k]), int(starts[k + 1])) in head
                    and ids[head[int(starts[k]), int(starts[k + 1])]] == right[k]]
            left_done, right_done = a == 0 or from_left is not None, b == len(right) or bool(tail)
            if left_done and right_done:
                if a == 0:
                    before, first = [], 0
                else:
                    before, first = left[:from_left], head[int(ends[from_left]), int(ends[from_left + 1])]
                if b == len(right):
                    return before + ids[first:]
                k = tail[-1]
                stop = head[int(starts[k]), int(starts[k + 1])]
                if stop >= first:
                    return before + ids[first:stop] + right[k:]
            reach *= 2

    def _window(self, text: str) -> list[int]:
        return self.bare.encode(text, add_special_tokens=False).ids

    def _piece(self, text: str) -> list[int]:
        """Ids of text without ASCII white space."""
        if len(text) <= self.leaf:
            return self.whole.encode(text, add_special_tokens=False).ids
        out: list[int] = []
        for part in self.special.split(text) if self.special else [text]:
            if self.special and self.special.fullmatch(part):
                out.append(self.whole.token_to_id(part))
            elif part:
                normal = self.whole.normalizer.normalize_str(part) if self.whole.normalizer else part
                for unit, _ in self.whole.pre_tokenizer.pre_tokenize_str(normal):
                    out += self.unit(unit)
        return out

    @staticmethod
    def _plain(piece: bytes) -> tuple[str, bytes] | None:
        """(lower-case word, mark) if a piece is a word of Latin letters with at most one mark after it.

        The normaliser and splitter then do no more than lower its case and part the mark, as no letter
        here has a context-dependent lower case and a single mark after an ASCII letter stands alone.
        """
        mark = b""
        if piece[-1:] in _MARKS and piece[-2:-1].isalpha():
            piece, mark = piece[:-1], piece[-1:]
        if piece.isalpha():
            return piece.decode().lower(), mark
        word = piece.decode()
        if word.isalpha() and max(word) < "\u0250" and is_normalized("NFC", word):
            lower = word.lower()
            if lower.isalpha():
                return lower, mark
        return None

    def _learn(self, pieces: list[bytes]) -> None:
        """Put the ids of new pieces into the cache."""
        if len(self.words) > CACHE * 3 // 2:
            self.words.clear()
        plain = {p: found for p in pieces if (found := self._plain(p))}
        new = list(dict.fromkeys(x for w, m in plain.values() for x in (w, m.decode()) if x not in self.words))
        units = [w if w.isascii() else "".join([self.letters[b] for b in w.encode()]) for w in new]
        for w, e in zip(new, self.bare.encode_batch_fast(units, add_special_tokens=False)):
            self.words[w] = array("I", e.ids).tobytes()
        for p, (w, m) in plain.items():
            self.cache[p] = self.words[w] + self.words[m.decode()] if m else self.words[w]
        rest = [p for p in pieces if p not in plain]
        for p, e in zip(rest, self.whole.encode_batch_fast([p.decode() for p in rest], add_special_tokens=False)):
            self.cache[p] = array("I", e.ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text (UTF-8)."""
        cache, leaf = self.cache, self.leaf
        split = [t.split() for t in texts]
        pieces = dict.fromkeys(p for words in split for p in words)
        short = [p for p in pieces if len(p) <= leaf]
        new = [p for p in short if p not in cache]
        if len(cache) + len(new) > CACHE:     # the cache starts anew with what this slice needs
            cache.clear()
            new = short
        if new:
            self._learn(new)
        if len(short) < len(pieces):
            long = {p: array("I", self._piece(p.decode())).tobytes() for p in pieces if len(p) > leaf}
            return [b"".join([long[p] if p in long else cache[p] for p in words]) for words in split]
        return [b"".join([cache[p] for p in words]) for words in split]

    def decode(self, ids: bytes) -> str:
        token = self.token
        return " ".join([token[i] for i in array("I", ids)])


def spans(text: bytes, size: int) -> list[bytes]:
    """Parts of about ``size`` bytes, cut only at ASCII white space."""
    out, at, gap = [], 0, re.compile(rb"[\x09-\x0d\x20]")
    while len(text) - at > size:
        found = gap.search(text, at + size)
        if not found:
            break
        out.append(text[at: found.start()])
        at = found.end()
    return [*out, text[at:]]


def _map(source: DataFrame, path: str, leaf: int, carried: list[str], make: Callable[[Codec, pa.RecordBatch], dict[str, list]],
         made: str, column: str) -> DataFrame:
    """Slices of ``source`` through ``make``; ``carried`` columns stay, ``made`` names the new ones with their types."""
    names = [m.split()[0] for m in made.split(", ")]
    kinds = {"binary": pa.binary(), "string": pa.string()}
    types = [kinds[m.split()[1]] for m in made.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, 2 << 20):
                new = make(codec(path, leaf), part)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carried], *[pa.array(new[n], t) for n, t in zip(names, types)]],
                                                 names=[*carried, *names])

    fields = [f"{c} {source.schema[c].dataType.simpleString()}" for c in carried]
    return map_arrow(source, run, ", ".join([*fields, made]))


def _texts(part: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]


def _encode(by: Codec, part: pa.RecordBatch) -> dict[str, list]:
    return {"ids": by.encode(_texts(part))}


def _decode(by: Codec, part: pa.RecordBatch) -> dict[str, list]:
    return {"text": [by.decode(i or b"") for i in part.column("ids").to_pylist()]}


def _both(by: Codec, part: pa.RecordBatch) -> dict[str, list]:
    ids = by.encode(_texts(part))
    return {"ids": ids, "text": [by.decode(i) for i in ids]}


def _long_encoded(docs: DataFrame, path: str, long_text: int, leaf: int) -> DataFrame:
    """(doc_id, ids) of texts of over ``long_text`` characters: spans of a text are encoded as rows of their own."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for k, p in enumerate(spans(batch.column("text")[i].as_py().encode(), long_text)):
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, 1) for c in ("doc_id", "row")],
                                                      pa.array([k], pa.int32()), pa.array([p], pa.binary())],
                                                     names=["doc_id", "row", "part", "text"])

    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    rows = map_arrow(rows, cut, f"doc_id {kind}, row long, part int, text binary")
    parts = _map(rows.repartition("row", "part"), path, leaf, ["doc_id", "row", "part"], _encode, "ids binary", "text")
    # equal rows share a row key: their equal parts are one, and the row comes back as often as its first part
    return (parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_set(F.struct("part", "ids"))).alias("p"),
                                     F.count_if(F.col("part") == 0).cast("int").alias("copies"))
            .select("doc_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
                    F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("doc_id", "ids"))


def _parts(docs: DataFrame, long_text: int) -> tuple[DataFrame, DataFrame]:
    rows = docs.select("doc_id", "text")
    is_long = F.coalesce(F.length("text") > long_text, F.lit(False))
    return rows.where(~is_long), rows.where(is_long)


def encode(docs: DataFrame, path: str, long_text: int = LONG_TEXT, leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids): ``ids`` is a binary of little-endian unsigned 32-bit integers, one row per row of ``docs``."""
    short, long = _parts(docs, long_text)
    return _map(short, path, leaf, ["doc_id"], _encode, "ids binary", "text").unionByName(_long_encoded(long, path, long_text, leaf))


def decode(encoded: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids, text): the text that the library's ``decode`` gives for the ids."""
    return _map(encoded.select("doc_id", "ids"), path, leaf, ["doc_id", "ids"], _decode, "text string", "ids")


def round_trip(docs: DataFrame, path: str, long_text: int = LONG_TEXT, leaf: int = LEAF) -> DataFrame:
    """``decode(encode(docs))`` with one Python worker per task where a text is encoded whole."""
    short, long = _parts(docs, long_text)
    return _map(short, path, leaf, ["doc_id"], _both, "ids binary, text string", "text").unionByName(
        decode(_long_encoded(long, path, long_text, leaf), path, leaf))


def digests(decoded: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return decoded.select(
        "doc_id", *keep, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def op9_bpe_tree_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    return digests(round_trip(read_table(spark, sf_dir, "documents"), path))
