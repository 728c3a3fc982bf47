"""Column-expression helpers (all built-in Spark expressions, no UDFs)."""

from shelfcast.functions.pynum import py_round, py_fmt  # noqa: F401
from shelfcast.functions.calendar import calendar_columns  # noqa: F401
