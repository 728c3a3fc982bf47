"""Mixing sources to target weights (operator 5).

Every row gets a hash-random key.  Within a source the rows are ordered by
key, sizes are summed along that order, and the order is cut where the
source's budget ends; a budget above the source's size repeats whole epochs
first.  The row at the cut gives only the words that are left, so a source
gives exactly its target (rounded down to a word).

The order is never built for a whole source.  Keys are uniform, so equal
ranges of keys hold nearly equal shares: sizes are summed per (source, range),
a prefix sum over the ranges finds the one where the budget ends, and only that
range is sorted.  The size of a range grows with the square root of the row
count, so neither the ranges of a source nor the rows of a range become one
large task, whatever share of the rows one source holds.

The cut is one row per source (key, words left), joined back on the source.

Edge cases: a null text has size 0; a null source is a source of its own, the
last one; sources of size 0 get target 0; an empty table gives an empty result;
rows with the same id and text share a key and, at the cut, the words left in
proportion to their sizes (rounded down); other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import fresh, read_table, staged

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_key(seed: int = SEED) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, n_rows, source_size, target): one row per source.

    The targets are a water level: with sources ordered by cap over weight,
    all before the first that stays below its cap are full, and the rest share
    what is left by weight.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    every = Window.partitionBy(F.lit(1))
    before = Window.partitionBy(F.lit(1)).orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, -1)
    level = ((share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    ranked = (per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_epochs))
              .withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("level", level)
              .withColumn("open", F.col("level") <= F.col("ratio")))
    water = F.max(F.when(F.col("open"), F.struct(-F.col("ratio"), "level"))).over(every)["level"]
    target = F.when(F.col("open"), F.least(F.col("cap"), water * F.col("weight"))).otherwise(F.col("cap"))
    return ranked.withColumn("target", target).select("source", "n_rows", "source_size", "target")


def source_cuts(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, epochs, cut_key, cut_words, cut_size): where each source's last epoch ends.

    ``cut_key`` is null where nothing is taken beyond whole epochs.
    """
    budget = F.floor(F.col("target") + F.lit(1e-6))
    plan = (targets.withColumn("budget", budget)
            .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0))
            .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
            .withColumn("total", F.sum("n_rows").over(Window.partitionBy(F.lit(1))))
            .withColumn("ranges", F.ceil(F.col("n_rows") / F.greatest(F.lit(2000.0), F.sqrt("total"))))
            .drop("n_rows", "total"))
    own = plan.select(F.col("source").alias("_s"), "ranges", "rest")
    ranged = (sized.join(own, sized["source"].eqNullSafe(own["_s"]))
              .withColumn("range", F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * F.col("ranges")))
              .select("source", "key", "size", "range", "rest"))
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("source", "range", "rest").agg(F.sum("size").alias("n")).withColumn(
        "base", F.coalesce(F.sum("n").over(along), F.lit(0)))
    at = sums.where("base < rest and rest <= base + n").select(F.col("source").alias("_s"), F.col("range").alias("_r"), "base")
    inside = ranged.join(at, ranged["source"].eqNullSafe(at["_s"]) & (ranged["range"] == at["_r"]))
    keys = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    ends = (inside.groupBy("source", "rest", "base", "key").agg(F.sum("size").alias("n"))
            .withColumn("start", F.col("base") + F.coalesce(F.sum("n").over(keys), F.lit(0)))
            .where("start < rest and rest <= start + n")
            .select(F.col("source").alias("_s"), F.col("key").alias("cut_key"),
                    (F.col("rest") - F.col("start")).alias("cut_words"), F.col("n").alias("cut_size")))
    return (plan.join(ends, plan["source"].eqNullSafe(ends["_s"]), "left")
            .select("source", "source_size", "target", "epochs", "cut_key", "cut_words", "cut_size"))


def _last_epoch(key: Column, size: Column, names: dict[str, str] | None = None) -> Column:
    """Words that the unfinished epoch takes from a row; ``names`` maps the cut's columns to other names."""
    cut_key, cut_words, cut_size = (F.col((names or {}).get(c, c)) for c in ("cut_key", "cut_words", "cut_size"))
    share = F.floor(size * cut_words / cut_size)
    return F.when(key < cut_key, size).when(key == cut_key, share).otherwise(F.lit(0)).cast("long")


def _cuts(docs: DataFrame, weights: tuple[int, ...], share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    sized = staged(docs.select("doc_id", "source", mix_key(seed).alias("key"), word_count(F.col("text")).alias("size")), "sizes")
    cuts = source_cuts(sized, staged(source_targets(sized, weights, share), "targets"))
    return sized, staged(cuts.withColumnRenamed("source", "_s"), "cuts")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``."""
    sized, cuts = _cuts(docs, weights, share, seed)
    taken = (F.col("epochs") * F.col("size") + _last_epoch(F.col("key"), F.col("size"))).cast("long")
    return (sized.join(cuts, sized["source"].eqNullSafe(cuts["_s"]))
            .select("doc_id", "source", "size", "source_size", "target", taken.alias("taken")))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """The mix itself: rows of ``docs`` once per epoch that takes them.

    A row at a cut appears with its first words only (joined by one space),
    and ``n_chars`` follows; rows that no epoch takes, and rows without a word, go.
    """
    _, cuts = _cuts(docs, weights, share, seed)
    own = fresh(docs, *cuts.columns)
    cuts = cuts.toDF(*own)
    by = dict(zip(("_s", "source_size", "target", "epochs", "cut_key", "cut_words", "cut_size"), own))
    key, size, take = fresh(docs, "mix_key", "mix_size", "mix_take")
    rows = docs.withColumn(key, mix_key(seed)).withColumn(size, word_count(F.col("text")))
    rows = rows.join(cuts, rows["source"].eqNullSafe(cuts[by["_s"]])).where(F.col(size) > 0)
    last = _last_epoch(F.col(key), F.col(size), by)
    whole = F.array_repeat(F.col(size), F.col(by["epochs"]).cast("int"))
    part = F.when(last > 0, F.array(last)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn(take, F.explode(F.concat(whole, part)))
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col(take).cast("int")), " ")
    out = rows.withColumn("text", F.when(F.col(take) < F.col(size), head).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
