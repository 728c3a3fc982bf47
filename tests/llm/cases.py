"""Small inputs that every operator has to stand."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], SCHEMA)


PASSAGE = " ".join(f"shared{i}" for i in range(30))
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))

#: nulls, empty and blank texts, repeated rows, ties, a shared passage, a very long text
ODD = [
    (None, None, None, None), (None, "no id here but words", "en", None), (1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", None),
    (4, f"before {PASSAGE} after", "en", "a"), (5, f"other {PASSAGE} words", "en", "b"), (5, f"other {PASSAGE} words", "en", "b"),
    (6, "ümläut Größe naïve 日本語   x", "de", "b"), (7, LONG, "en", "c"), (8, "one", "fr", "c"), (9, PASSAGE + "\n" + PASSAGE, "en", "c"),
    (10, "one", "fr", ""), (11, "12345 !!! ***", None, "a"),
]


def clashing(df):
    """The same rows with extra columns named like those that operators make."""
    from pyspark.sql import functions as F

    names = ["score", "lang_pred", "fp", "key", "size", "h", "rk", "z", "k0", "label", "features", "ids", "row", "part", "component_id",
             "target", "taken", "_h", "_s", "_key", "range", "words", "lines", "host"]
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


def rows_of(df, columns=None):
    return sorted(map(repr, (tuple(r) for r in (df.select(*columns) if columns else df).collect())))
