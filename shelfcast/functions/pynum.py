"""Python-compatible rounding and fixed-point formatting as Column expressions.

The decisions and messages are specified with Python's ``round(x, n)`` and
``f"{x:.nf}"``: both round the *exact binary value* of a double, ties to
even.  Spark's ``round``/``bround`` and ``format_string`` work on the
shortest decimal representation and round ties up, so ``round(2.675, 2)``
gives 2.68 in Spark but 2.67 in Python.

``py_round`` reproduces Python bit for bit with plain double arithmetic:
``p = |x| * 10^n`` is computed together with its exact rounding error ``e``
(Dekker's two-product; ``10^n`` has at most 27 significant bits for
``n <= 8`` so no split of it is needed).  Only when ``p`` lands exactly on
``k + 0.5`` does the sign of ``e`` decide, and an exact tie goes to even.
The result ``k / 10^n`` is a correctly rounded IEEE division, which is the
double Python returns.  Everything stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPLIT = 134217729.0          # 2^27 + 1, Veltkamp split constant
_EXACT_LIMIT = 4503599627370496.0  # 2^52: above it every double is an integer


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _round_sql(x: str, n: int) -> str:
    """The rounding below as one Spark SQL expression over the SQL text ``x``."""
    s = f"CAST({float(10 ** n)!r} AS DOUBLE)"
    a = f"abs({x})"
    c = f"({a} * CAST({_SPLIT!r} AS DOUBLE))"
    hi = f"({c} - ({c} - {a}))"
    lo = f"({a} - {hi})"
    p = f"({a} * {s})"
    err = f"(({hi} * {s} - {p}) + {lo} * {s})"
    f = f"CAST(floor({p}) AS DOUBLE)"
    d = f"({p} - {f})"
    k = (f"CASE WHEN {d} > 0.5D THEN {f} + 1.0D WHEN {d} < 0.5D THEN {f} "
         f"WHEN {err} > 0.0D THEN {f} + 1.0D WHEN {err} < 0.0D THEN {f} "
         f"WHEN floor({f} / 2.0D) * 2.0D = {f} THEN {f} ELSE {f} + 1.0D END")
    return (f"CASE WHEN isnan({x}) OR {p} >= CAST({_EXACT_LIMIT!r} AS DOUBLE) THEN {x} "
            f"WHEN {x} = 0.0D THEN {x} ELSE (({k}) / {s}) * signum({x}) END")


def py_round(x, n: int = 2) -> Column:
    """``round(x, n)`` with Python semantics (exact value, ties to even).

    ``x`` is a column name / SQL expression (one parsed expression, cheap
    to build) or a Column (built node by node).
    """
    if not 0 <= n <= 8:
        raise ValueError("py_round supports 0..8 decimals")
    if isinstance(x, str):
        return F.expr(_round_sql(f"CAST(({x}) AS DOUBLE)", n))
    x = _col(x).cast("double")
    s = float(10 ** n)
    a = F.abs(x)
    c = a * F.lit(_SPLIT)
    hi = c - (c - a)
    lo = a - hi
    p = a * F.lit(s)
    err = (hi * F.lit(s) - p) + lo * F.lit(s)
    f = F.floor(p).cast("double")
    d = p - f
    k = (F.when(d > 0.5, f + 1.0)
         .when(d < 0.5, f)
         .when(err > 0.0, f + 1.0)
         .when(err < 0.0, f)
         .when(F.floor(f / 2.0) * 2.0 == f, f)
         .otherwise(f + 1.0))
    mag = k / F.lit(s)
    rounded = mag * F.signum(x)          # keeps the sign of -0.0 like Python
    return (F.when(F.isnan(x) | (p >= F.lit(_EXACT_LIMIT)), x)
            .when(x == 0.0, x)
            .otherwise(rounded))


def py_fmt(x, n: int = 2) -> Column:
    """``f"{x:.nf}"`` with Python semantics; a missing value gives NULL, whose text is the caller's choice."""
    if isinstance(x, str):
        value = f"CAST(({x}) AS DOUBLE)"
        return F.expr(f"IF(({x}) IS NULL, NULL, format_string('%.{n}f', {_round_sql(value, n)}))")
    return F.when(x.isNotNull(), F.format_string(f"%.{n}f", py_round(x, n)))


FORMATS_AT_ONCE = 4     # formats per projection: each projection is one generated method


def with_formats(df: DataFrame, formats: dict[str, tuple[str, int]]) -> DataFrame:
    """``df`` with a ``py_fmt`` text per entry (name -> (SQL expression, decimals)).

    The same arithmetic as ``py_fmt``, but every intermediate value is a column of a projection of its own, so the generated
    code of many formats stays small.
    """
    names = list(formats)
    for at in range(0, len(names), FORMATS_AT_ONCE):
        some = names[at:at + FORMATS_AT_ONCE]
        x, p, c, h, f, e = ({name: f"`_{k}_{name}`" for name in some} for k in "xpchfe")
        scale = {name: f"CAST({float(10 ** formats[name][1])!r} AS DOUBLE)" for name in some}
        before = df.columns
        df = df.select("*", *[F.expr(f"CAST(({formats[n][0]}) AS DOUBLE) AS {x[n]}") for n in some])
        df = df.select("*", *[F.expr(f"abs({x[n]}) * {scale[n]} AS {p[n]}") for n in some],
                       *[F.expr(f"abs({x[n]}) * CAST({_SPLIT!r} AS DOUBLE) AS {c[n]}") for n in some])
        df = df.select("*", *[F.expr(f"{c[n]} - ({c[n]} - abs({x[n]})) AS {h[n]}") for n in some],
                       *[F.expr(f"CAST(floor({p[n]}) AS DOUBLE) AS {f[n]}") for n in some])
        df = df.select("*", *[F.expr(f"({h[n]} * {scale[n]} - {p[n]}) + (abs({x[n]}) - {h[n]}) * {scale[n]} AS {e[n]}") for n in some])
        texts = [F.expr(
            f"format_string('%.{formats[n][1]}f', CASE WHEN isnan({x[n]}) OR {p[n]} >= CAST({_EXACT_LIMIT!r} AS DOUBLE) OR {x[n]} = 0.0D THEN {x[n]} "
            f"ELSE (({f[n]} + CASE WHEN {p[n]} - {f[n]} > 0.5D THEN 1.0D WHEN {p[n]} - {f[n]} < 0.5D THEN 0.0D WHEN {e[n]} > 0.0D THEN 1.0D "
            f"WHEN {e[n]} < 0.0D THEN 0.0D ELSE {f[n]} - floor({f[n]} / 2.0D) * 2.0D END) / {scale[n]}) * signum({x[n]}) END) AS `_t_{n}`") for n in some]
        df = df.select(*[f"`{b}`" for b in before], *[x[n] for n in some], *texts)
        df = df.select(*[f"`{b}`" for b in before], *[F.expr(f"IF({x[n]} IS NULL, NULL, `_t_{n}`) AS `{n}`") for n in some])
    return df
