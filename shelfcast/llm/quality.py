"""Quality rules as a short-circuit cascade (operator 10), DataFrame functions only.

A rule is a rejection condition over a row's base counts and text.  On a
bounded sample each rule is run alone: its time is its cost, the share of rows
it rejects its selectivity.  The cascade tries rules by falling rejection per
cost and stops at the first that rejects (``CASE`` evaluates no later branch),
so the order changes the work, never the verdict.

Repeated words are found inside the row, without a shuffle: words become
64-bit hashes, every three neighbours one hash, and only texts in which some
hash recurs sort their (hash, position) pairs to see which positions recur.

Edge cases: a null or empty text has no words and fails the base rules; an
empty table needs no sample and gives an empty result; repeated rows each
return a row; other columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.common import read_table, staged

SAMPLE_ROWS = 2000
REPEATS = 10            # evaluations of each sampled row
LEAST_SECONDS = 0.03    # below this two rules cost the same
SPACE = " \t\n\x0b\x0c\r"
GAP = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"

#: name -> rejection condition; thresholds are parameters of the rule set.
RULES: dict[str, Callable[[], Column]] = {
    "symbols": lambda: F.col("n_symbols") * 10 > F.col("n_words"),
    "duplicate_lines": lambda: F.col("n_dup_lines") * 2 > F.col("n_lines"),
    "short_words": lambda: F.col("word_chars") < F.col("n_words") * 2,
    "long_words": lambda: F.col("word_chars") > F.col("n_words") * 15,
    "capitals": lambda: F.regexp_count("text", F.lit("\\p{Lu}")) * 5 > F.col("word_chars") * 2,
    "digits": lambda: F.regexp_count("text", F.lit("[0-9]")) * 2 > F.col("word_chars"),
    "ellipsis_lines": lambda: F.regexp_count("text", F.lit("(?m)(\\.\\.\\.|…)$")) * 2 > F.col("n_lines"),
}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def _repeat_words(pairs: Column) -> Column:
    """Positions covered by the three-word windows whose hash recurs, from sorted (hash, position) pairs."""
    def recurs(e: Column, i: Column) -> Column:
        return ((F.get(pairs, i - 1)["h"] == e["h"]).eqNullSafe(True)) | ((F.get(pairs, i + 1)["h"] == e["h"]).eqNullSafe(True))

    return F.sort_array(F.transform(F.filter(pairs, recurs), lambda e: e["p"]))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) for every row."""
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("trimmed", F.btrim("text", F.lit(SPACE)))
    words = F.split("trimmed", GAP)
    rows = rows.select(
        "doc_id", "text", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(words).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("lines"))
    rows = rows.select(
        "doc_id", "text", F.size("words").cast("long").alias("n_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    counts = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")
    triple = F.transform("h", lambda x, i: F.xxhash64(x, F.get("h", i + 1), F.get("h", i + 2)))
    rows = rows.select("doc_id", "text", *counts, F.slice(triple, F.lit(1), F.greatest(F.size("h") - 2, F.lit(0))).alias("t"))
    pairs = F.transform("t", lambda x, i: F.struct(x.alias("h"), i.alias("p")))
    rows = rows.select("doc_id", "text", *counts,
                       F.when(F.size(F.array_distinct("t")) < F.size("t"), F.sort_array(pairs)).alias("pairs"))
    rows = rows.select("doc_id", "text", *counts, F.when(F.col("pairs").isNotNull(), _repeat_words(F.col("pairs"))).alias("at"))
    covered = F.aggregate(F.transform("at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - p, F.lit(3)))),
                          F.lit(0).cast("long"), lambda a, n: a + n)
    return rows.select("doc_id", "text", *counts, F.coalesce(F.when(F.col("at").isNotNull(), covered), F.lit(0)).alias("n_repeat_words"))


def _seconds(rows: DataFrame, condition: Column) -> float:
    """The faster of two runs that evaluate ``condition`` on every row."""
    found = []
    for _ in range(2):
        began = time.perf_counter()
        rows.agg(F.count_if(condition)).collect()
        found.append(time.perf_counter() - began)
    return min(found)


def rule_order(docs: DataFrame, rules: dict[str, Callable[[], Column]] = RULES, rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, rejected share, seconds) by falling rejection per cost, measured on about ``rows`` rows.

    Each sampled row is evaluated ``REPEATS`` times, so that a rule's work rises above a job's start, and the time of a job
    that evaluates no rule is taken off.  Rules that reject nothing come last, the cheap ones first.
    """
    total = docs.select("doc_id").count()
    if not total:
        return [(name, 0.0, 0.0) for name in rules]
    part = docs if total <= rows else docs.where(
        F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) < int(rows / total * (1 << 30)))
    # the filter stands above the written sample: below it, its condition would repeat the whole derivation of the counts
    sample = staged(measured(part), "quality-sample").where(~base_failed())
    shares = sample.agg(F.count("*").alias("n"), *[F.count_if(rule()).alias(name) for name, rule in rules.items()]).first()
    many = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))
    none = _seconds(many, (F.col("again") + F.length("text")) < 0)
    found = []
    for name, rule in rules.items():
        # the count of the copy keeps the condition from being evaluated once for all copies
        spent = _seconds(many, rule() & ((F.col("again") + F.length("text")) > 0))
        found.append((name, shares[name] / max(shares["n"], 1), max(spent - none, LEAST_SECONDS)))
    return sorted(found, key=lambda r: (-r[1] / r[2], r[2], r[0]))


def verdict(order: list[str], rules: dict[str, Callable[[], Column]] = RULES) -> Column:
    """The first rule that rejects, or null: one CASE in the given order."""
    chain = F.when(base_failed(), F.lit("base"))
    for name in order:
        chain = chain.when(rules[name](), F.lit(name))
    return chain


def judge(docs: DataFrame, rules: dict[str, Callable[[], Column]] = RULES, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The base counts of every row with ``base_failed`` and ``kept``."""
    order = [name for name, _, _ in rule_order(docs, rules, rows)]
    return (measured(docs).withColumn("kept", verdict(order, rules).isNull())
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    base_failed().alias("base_failed"), "kept"))


def op10_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM documents),
w AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS p FROM d),
t AS (SELECT r, p, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY r ORDER BY p)),
f AS (SELECT r, p, count(*) OVER (PARTITION BY r, w, w2, w3) AS n FROM t WHERE w3 IS NOT NULL),
c AS (SELECT r, count(DISTINCT p + k) AS n_repeat_words FROM f, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY r),
b AS (
  SELECT d.doc_id, d.text, len(words)::BIGINT AS n_words,
         length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(d.text) - length(translate(d.text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN c USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols * 10 > n_words OR n_dup_lines * 2 > n_lines
            OR word_chars < n_words * 2 OR word_chars > n_words * 15
            OR len(regexp_extract_all(text, '\p{Lu}')) * 5 > word_chars * 2
            OR len(regexp_extract_all(text, '[0-9]')) * 2 > word_chars
            OR len(regexp_extract_all(text, '(?m)(\.\.\.|…)$')) * 2 > n_lines) AS kept
FROM b
"""
