"""Toxicity by gradient-boosted trees over dense features, calibrated (operator 4).

A text becomes ``FEATURES``: densities of a lexicon (a short fixed list of
insults, and words and word stems whose odds the training labels raise), how
near its hits are to second-person words, capitals, punctuation, and obfuscated
spellings.  Boosted trees score the features; an isotonic regression, fitted on
labelled rows the trees did not see, turns scores into probabilities.

Training uses at most about ``TRAIN_ROWS`` labelled rows, chosen by a hash of the
id (a documented bound, which also bounds what is broadcast), and never rows
of fold 0.  Lexicon entries need ``LEAST_DOCS`` toxic documents.

Edge cases: null and empty texts have all features 0 and get the model's score
for that; without both labels among the training rows every score is the share
of toxic labels (0 without rows); labels without a document, null labels and
null ids are ignored, of repeated labels the highest counts; repeated rows each
return a row; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.common import byte_view, fold, map_arrow, read_table, slices, staged

TRAIN_ROWS = 20_000
LEAST_DOCS = 6
LEAST_ODDS = 2.0
MAX_ENTRIES = 20_000
STEMS = (4, 5, 6)
NEAR = 5

#: Fixed word lists: common insults, and second-person words.
INSULTS = ("idiot moron stupid dumb loser pathetic worthless trash scum disgusting clown fool imbecile jerk"
           " dumm blöd trottel abschaum widerlich versager connard crétin débile ordure minable"
           " estúpido imbécil basura asqueroso inútil").split()
SECOND_PERSON = set("you your yours yourself u ur du dich dir dein deine euch ihr tu toi te ton ta tes vous votre vos tú ti usted"
                    " ustedes tus vosotros".split())
_WORDS = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"\b[A-ZÄÖÜÉÈÀÑÓÍ]{3,}\b")
#: Letters, masking characters, letters or digits; tried only where a run of letters begins and never inside it, so the scan is linear.
_MASKED = re.compile(r"(?<![^\W\d_])[^\W\d_]++[*@$013457!]+[^\W_]+")
_UNMASK = str.maketrans({"@": "a", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "!": "i", "*": None})
FEATURES = ["log_words", "fixed_hits", "fixed_density", "word_hits", "word_density", "word_odds", "stem_hits", "stem_density",
            "stem_odds", "near_you", "you_density", "capitals", "shouting", "exclamations", "questions", "punctuation",
            "masked", "masked_hits", "stretched"]
_STRETCHED = re.compile(r"([^\W\d_])\1\1")


@dataclass
class Lexicon:
    """Learned log odds of words and of word stems (the first 4 to 6 letters)."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)


def _bytes_in(texts: pa.Array) -> np.ndarray:
    """Per text: capital ASCII letters, '!', '?', other ASCII punctuation."""
    data, offsets = byte_view(texts)
    kinds = np.zeros(256, dtype=np.uint8)
    kinds[[b for b in range(33, 127) if not chr(b).isalnum()]] = 4
    kinds[65:91], kinds[33], kinds[63] = 1, 2, 3
    kind = kinds[data]
    out = np.zeros((len(offsets) - 1, 4))
    for k in range(4):
        total = np.concatenate(([0], np.cumsum(kind == k + 1)))[offsets]
        out[:, k] = np.diff(total)
    return out


def _hits(words: list[str], lexicon: Lexicon, heads: set[str]) -> tuple[list[int], list[float], list[int], list[float]]:
    """Places and odds of lexicon words and stems."""
    get = lexicon.words.get
    at = [i for i, w in enumerate(words) if w in lexicon.words] if lexicon.words else []
    stems, odds = [], []
    for i in [i for i, w in enumerate(words) if w[:4] in heads] if heads else []:
        best = max((lexicon.stems.get(words[i][:n], 0.0) for n in STEMS if len(words[i]) > n), default=0.0)
        if best:
            stems.append(i)
            odds.append(best)
    return at, [get(words[i]) for i in at], stems, odds


def feature_rows(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    fixed, heads = set(INSULTS), {s[:4] for s in lexicon.stems}
    known = fixed | set(lexicon.words)
    out = np.zeros((len(texts), len(FEATURES)))
    marks = _bytes_in(texts)
    for row, text in enumerate(texts.to_pylist()):
        if not text:
            continue
        words = _WORDS.findall(text.lower())
        n = max(len(words), 1)
        sure = [i for i, w in enumerate(words) if w in fixed]
        at, odds, stems, stem_odds = _hits(words, lexicon, heads)
        hits = sorted({*sure, *at, *stems})
        you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        near = 0
        if hits and you:
            place = np.searchsorted(you, hits)
            spots = np.array([-10**9, *you, 10**9])
            near = int((np.minimum(np.array(hits) - spots[place], spots[place + 1] - np.array(hits)) <= NEAR).sum())
        masked = _MASKED.findall(text.lower())
        chars = len(text)
        caps, bangs, asks, other = marks[row]
        out[row] = (math.log1p(n), len(sure), 100 * len(sure) / n, len(at), 100 * len(at) / n, max(odds, default=0.0), len(stems),
                    100 * len(stems) / n, max(stem_odds, default=0.0), near, 100 * len(you) / n, caps / chars,
                    100 * len(_SHOUT.findall(text)) / n, 100 * bangs / chars, 100 * asks / chars, 100 * other / chars,
                    100 * len(masked) / n, sum(m.translate(_UNMASK) in known for m in masked), 100 * len(_STRETCHED.findall(text)) / n)
    return out


def features(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``FEATURES`` of every row."""
    source = docs.select(*keep, "text")
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = feature_rows(part.column("text"), shared.value)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *[pa.array(c) for c in rows.T]],
                                                 names=[*keep, *FEATURES])

    kinds = [f"{c} {source.schema[c].dataType.simpleString()}" for c in keep]
    return map_arrow(source, run, ", ".join([*kinds, *[f"{f} double" for f in FEATURES]]))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(part, text, toxic): a bounded sample of labelled documents outside fold 0; ``part`` is the fold."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    total = known.count()
    if total > rows:
        known = known.where(F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 30)) < int(rows / total * (1 << 30)))
    # at most about `rows` ids and labels: the parameter bounds the broadcast
    picked = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    return staged(picked.select(fold(F.col("doc_id")).alias("part"), "text", "toxic"), "toxic-training")


def _entries(text: str | None) -> set[str]:
    """Words of a text, and stems marked by a final '-'."""
    words = set(_WORDS.findall((text or "").lower()))
    return words | {f"{w[:n]}-" for w in words for n in STEMS if len(w) > n}


def learn_lexicon(training: DataFrame) -> Lexicon:
    """Entries whose share of toxic documents is well above that of clean ones."""
    spark = training.sparkSession

    def count(wanted):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    found: Counter = Counter()
                    for text in part.column("text").to_pylist():
                        entries = _entries(text)
                        found.update(entries if wanted is None else entries & wanted.value)
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
                                                     names=["entry", "n"])
        return run

    sizes = {r["toxic"]: r["n"] for r in training.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    top = (map_arrow(training.where("toxic = 1").select("text"), count(None), "entry string, n long").groupBy("entry")
           .agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCS).orderBy(F.desc("n"), "entry").limit(MAX_ENTRIES).collect())
    toxic = {r["entry"]: r["n"] for r in top}
    wanted = spark.sparkContext.broadcast(set(toxic))
    clean = {r["entry"]: r["n"] for r in map_arrow(training.where("toxic = 0").select("text"), count(wanted), "entry string, n long")
             .groupBy("entry").agg(F.sum("n").alias("n")).collect()}   # at most MAX_ENTRIES rows
    out = Lexicon()
    for entry, n in toxic.items():
        odds = math.log((n + 0.5) / (sizes.get(1, 0) + 1)) - math.log((clean.get(entry, 0) + 0.5) / (sizes.get(0, 0) + 1))
        if odds >= LEAST_ODDS:
            (out.stems if entry.endswith("-") else out.words)[entry.rstrip("-")] = odds
    return out


@dataclass
class Model:
    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    share: float


def _vector(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)


def _raw(trees: GBTClassificationModel, df: DataFrame) -> DataFrame:
    return trees.transform(df).withColumn("raw", vector_to_array("probability")[1])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, trees: int = 20, depth: int = 4) -> Model:
    training = training_rows(docs, labels, rows)
    seen = {r["toxic"]: r["n"] for r in training.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = seen.get(1, 0) / max(sum(seen.values()), 1)
    if len(seen) < 2:
        return Model(Lexicon(), None, None, share)
    lexicon = learn_lexicon(training.where("part != 4"))
    rows_ = _vector(staged(features(training, lexicon, ["part", "toxic"]), "toxic-features").coalesce(4))
    fit, rest = rows_.where("part != 4"), rows_.where("part = 4")
    if fit.select("toxic").distinct().count() < 2:
        fit = rows_
    model = GBTClassifier(labelCol="toxic", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=3, cacheNodeIds=False).fit(fit)
    held = _raw(model, rest if rest.select("toxic").distinct().count() == 2 else fit)
    calibration = IsotonicRegression(featuresCol="raw", labelCol="toxic", predictionCol="score").fit(
        held.select("raw", F.col("toxic").cast("double").alias("toxic")))
    return Model(lexicon, model, calibration, share)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) for every row; the raw score only parts equal calibrated ones."""
    if model.trees is None:
        return docs.select("doc_id", F.lit(model.share).alias("score"), F.lit(int(model.share >= 0.5)).alias("predicted"))
    raw = _raw(model.trees, _vector(features(docs, model.lexicon, ["doc_id"])))
    found = model.calibration.transform(raw.select("doc_id", "raw"))
    score = 0.999 * F.col("score") + 0.001 * F.col("raw")
    return found.select("doc_id", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op4_toxicity_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = predict(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
