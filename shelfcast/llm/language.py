"""Language identification by word-first backoff (operator 6).

A known word scores its per-language log frequency.  An unseen word falls back
to character n-grams of its letters with boundary marks: the longest length at
which any of its n-grams is known decides, by the mean log frequency of the
known ones.  A document's score is the softmax of its summed word scores,
tempered by the square root of the number of words.

The model is learned from at most about ``TRAIN_ROWS`` labelled rows, chosen
by a hash of the id (a documented bound on the sample); it keeps the
``MAX_WORDS`` / ``MAX_GRAMS`` most frequent entries, so its size is bounded too.

Edge cases: a null text, or one without a letter, gives ``und`` with score 0;
without any labelled row every text is ``und``; ties go to the first language
by code point; repeated rows each return a row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.common import fold, fresh, map_arrow, read_table, slices, staged

UNKNOWN = "und"
TRAIN_ROWS = 10_000
MAX_WORDS = 200_000
MAX_GRAMS = 100_000
LONGEST, SHORTEST = 5, 1
CACHE = 100_000
_LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> list[str]:
    """Lower-cased letter runs of a text; none if it has no letter."""
    if not text:
        return []
    found = _LETTERS.findall(text.lower())
    return found if any(c.isalpha() for w in found for c in w) else []


def grams(word: str, n: int) -> list[str]:
    """n-grams with boundary marks; single letters have none."""
    if n == 1:
        return list(word)
    marked = f"<{word}>"
    return [marked[i: i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    """Row i of ``scores`` belongs to the word or n-gram that ``words`` / ``grams`` maps to i."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    scores: np.ndarray


def shares(counts: dict[str, int], rows: int) -> dict[str, float]:
    """Rows to take per language, ``rows`` together: all of the small ones, the others an equal number."""
    out: dict[str, float] = {}
    left = float(rows)
    for k, lang in enumerate(sorted(counts, key=lambda x: (counts[x], x))):
        out[lang] = min(float(counts[lang]), left / (len(counts) - k))
        left -= out[lang]
    return out


def training_rows(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(lang, text) of a bounded sample of the labelled rows outside fold 0, in which every language has its share."""
    labelled = docs.where((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    cut = {lang: int(n / counts[lang] * (1 << 30)) for lang, n in shares(counts, rows).items() if n < counts[lang]}
    if cut:
        most = F.create_map(*[F.lit(x) for pair in cut.items() for x in pair])
        labelled = labelled.where(F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) < F.coalesce(most[F.col("lang")], F.lit(1 << 30)))
    return labelled.select("lang", "text")


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found: dict[str, Counter] = {}
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    found.setdefault(lang, Counter()).update(letters(text))
                out: Counter = Counter()
                for lang, words in found.items():
                    for w, n in words.items():
                        out[lang, "w", w] += n
                        for size in range(SHORTEST, LONGEST + 1):
                            for g in grams(w, size):
                                out[lang, "g", g] += n
                keys = list(out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array(list(out.values()), pa.int64())],
                    names=["lang", "kind", "entry", "n"])

    counted = map_arrow(training_rows(docs, rows), count, "lang string, kind string, entry string, n long")
    entries = staged(counted.groupBy("kind", "entry", "lang").agg(F.sum("n").alias("n"))
               .groupBy("kind", "entry").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by"))
               .where("total > 1"), "language-counts")
    # an entry counts by its largest share of any language's entries, so a language with few rows keeps its frequent ones as well
    totals = {(r["kind"], r["lang"]): r["n"] for r in entries.select("kind", F.explode("by").alias("x"))
              .groupBy("kind", "x.lang").agg(F.sum("x.n").alias("n")).collect()}
    top = {}
    for kind, most in (("w", MAX_WORDS), ("g", MAX_GRAMS)):
        of = [F.lit(x) for (k, lang), n in totals.items() if k == kind for x in (lang, float(n))]
        found = entries.where(F.col("kind") == kind)
        if of:
            share = F.array_max(F.transform("by", lambda x: x["n"] / F.create_map(*of)[x["lang"]]))
            found = found.orderBy(share.desc(), F.desc("total"), "entry").limit(most)
        top[kind] = found.select("entry", "by").toArrow()
    return _model(top["w"], top["g"])


def _model(words: pa.Table, found: pa.Table) -> Model:
    """Smoothed per-language log frequencies of the counted words and n-grams."""
    langs = sorted({x["lang"] for t in (words, found) for by in t.column("by").to_pylist() for x in by},
                   key=lambda s: s.encode())
    column = {lang: i for i, lang in enumerate(langs)}

    def logs(table: pa.Table) -> np.ndarray:
        counts = np.zeros((table.num_rows, len(langs)))
        for i, by in enumerate(table.column("by").to_pylist()):
            for x in by:
                counts[i, column[x["lang"]]] = x["n"]
        return np.log((counts + 0.5) / (counts.sum(axis=0, keepdims=True) + 0.5 * max(len(counts), 1)))

    names = [t.column("entry").to_pylist() for t in (words, found)]
    return Model(langs, {w: i for i, w in enumerate(names[0])}, {g: len(names[0]) + i for i, g in enumerate(names[1])},
                 np.concatenate([logs(words), logs(found)]).astype(np.float32))


class Scorer:
    """Word scores with a bounded cache of unseen words."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.unseen: dict[str, int] = {}
        self.scores = self.model.scores

    def _backoff(self, word: str) -> list[int]:
        for n in range(LONGEST, SHORTEST - 1, -1):
            known = [i for i in map(self.model.grams.get, grams(word, n)) if i is not None]
            if known:
                return known
        return []

    def documents(self, texts: list[list[str]]) -> np.ndarray:
        """Summed word scores, one row per text."""
        if len(self.unseen) > CACHE:
            self.reset()
        get, other = self.model.words.get, self.unseen
        flat = [w for words in texts for w in words]
        rows = np.array([get(w, -1) for w in flat], dtype=np.int64)
        missing = np.flatnonzero(rows < 0).tolist()
        new = list(dict.fromkeys(w for w in map(flat.__getitem__, missing) if w not in other))
        if new:
            known = [self._backoff(w) for w in new]
            sizes = np.array([len(k) for k in known])
            sums = np.zeros((len(new), len(self.model.langs)), dtype=np.float32)
            some = np.flatnonzero(sizes)
            if len(some):
                heads = (np.cumsum(sizes) - sizes)[some]
                index = np.array([i for k in known for i in k])
                sums[some] = np.add.reduceat(self.model.scores[index], heads) / sizes[some, None]
            for k, w in enumerate(new, len(self.scores)):
                other[w] = k
            self.scores = np.concatenate([self.scores, sums])
        if missing:
            rows[missing] = [other[flat[i]] for i in missing]
        out = np.zeros((len(texts), len(self.model.langs)))
        sizes = np.array([len(t) for t in texts])
        some = np.flatnonzero(sizes)
        if len(some):
            out[some] = np.add.reduceat(self.scores[rows], (np.cumsum(sizes) - sizes)[some], dtype=np.float64)
        return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added (or replaced)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    source = docs.drop("lang_pred", "score")
    schema = source.limit(0).selectExpr("*", "cast(null as string) lang_pred", "cast(null as double) score").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        langs = shared.value.langs
        for batch in batches:
            for part in slices(batch):
                texts = [letters(t) for t in part.column("text").to_pylist()]
                sizes = np.array([len(t) for t in texts])
                if langs:
                    logits = scorer.documents(texts) / np.sqrt(np.maximum(sizes, 1))[:, None]
                    odds = np.exp(logits - logits.max(axis=1, keepdims=True))
                    best = odds.argmax(axis=1)
                    share = odds.max(axis=1) / odds.sum(axis=1)
                names = [langs[best[i]] if n and langs else UNKNOWN for i, n in enumerate(sizes)]
                score = [float(share[i]) if n and langs else 0.0 for i, n in enumerate(sizes)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())],
                                                 names=[*part.schema.names, "lang_pred", "score"])

    return map_arrow(source, run, schema)


def identified(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` without the rows in no language (``und``); columns as before."""
    own = docs.withColumnsRenamed({c: fresh(docs, f"own_{c}")[0] for c in docs.columns if c in ("lang_pred", "score")})
    kept = predict(own, train(docs, rows)).where(F.col("lang_pred") != UNKNOWN)
    return kept.drop("lang_pred", "score").toDF(*docs.columns)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
