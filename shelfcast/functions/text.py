"""Text helpers: intent keywords and message templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Intent keyword lists, checked in this order (first match wins).
INTENT_KEYWORDS = (
    ("forecast", ("forecast", "demand", "prediction", "predict", "future", "next week")),
    ("risk", ("risk", "alert", "danger", "critical", "urgent", "warning")),
    ("reorder", ("reorder", "order", "purchase", "buy", "restock", "stock")),
    ("summary", ("summary", "report", "overview", "status", "dashboard")),
)
DEFAULT_INTENT = "summary"


def detect_intent(query: Column) -> Column:
    """Lower-case substring match, precedence forecast → risk → reorder → summary."""
    q = F.lower(query)
    out = F.lit(DEFAULT_INTENT)
    for intent, words in reversed(INTENT_KEYWORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | (F.instr(q, w) > 0)
        out = F.when(hit, F.lit(intent)).otherwise(out)
    return out


def fill(template: str, **parts: Column) -> Column:
    """Template with ``{name}`` placeholders → ``concat`` of literals and columns."""
    out: list[Column] = []
    rest = template
    while "{" in rest:
        head, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        if head:
            out.append(F.lit(head))
        out.append(parts[name])
    if rest:
        out.append(F.lit(rest))
    return F.concat(*out)
