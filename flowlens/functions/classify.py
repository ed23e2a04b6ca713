"""Error classification (F3, F4) and dead-letter alert/health levels.

All are built-in column expressions (``when`` chains, ``regexp_extract``), so
they stay inside whole-stage codegen. Each has a ``*_sql`` twin producing the
same expression for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered, case-insensitive substring table of the full classifier.
# First match wins; "DeserializationException" must precede "SerializationException".
ERROR_PATTERNS = [
    ("NullPointerException", "NullPointerException"),
    ("IllegalArgumentException", "IllegalArgumentException"),
    ("IllegalStateException", "IllegalStateException"),
    ("JsonParseException", "JSON Parse Error"),
    ("JsonMappingException", "JSON Mapping Error"),
    ("DeserializationException", "Deserialization Error"),
    ("SerializationException", "Serialization Error"),
    ("TimeoutException", "Timeout"),
    ("ConnectionException", "Connection Error"),
    ("SQLException", "Database Error"),
    ("DataIntegrityViolationException", "Data Integrity Error"),
    ("ConstraintViolationException", "Constraint Violation"),
    ("OptimisticLockingFailureException", "Optimistic Locking"),
    ("OutOfMemoryError", "Out of Memory"),
    ("StackOverflowError", "Stack Overflow"),
]
# Exception-class pattern applied to the first line only.
EXCEPTION_CLASS_REGEX = r"([A-Z][a-zA-Z]*Exception|[A-Z][a-zA-Z]*Error)"
FIRST_LINE_REGEX = r"^([^\r\n]*)"
BLANK_REGEX = r"^\s*$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _first_line_class(m: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(m, FIRST_LINE_REGEX, 1), EXCEPTION_CLASS_REGEX, 1)


def classify_error(msg) -> Column:
    """blank -> Unknown; first matching table entry over the whole text;
    else the exception class named on line 1; else "Other Error"."""
    m = _c(msg)
    lm = F.lower(m)
    e = F.when(m.isNull() | m.rlike(BLANK_REGEX), F.lit("Unknown"))
    for pat, name in ERROR_PATTERNS:
        e = e.when(lm.contains(pat.lower()), F.lit(name))
    cls = _first_line_class(m)
    return e.when(cls != "", cls).otherwise(F.lit("Other Error"))


def classify_error_short(msg) -> Column:
    """exception class on line 1 only; fallback "Other" (differs from F3 by design)."""
    m = _c(msg)
    cls = _first_line_class(m)
    return (F.when(m.isNull() | m.rlike(BLANK_REGEX), F.lit("Unknown"))
            .when(cls != "", cls).otherwise(F.lit("Other")))


def alert_level(pending, recent) -> Column:
    """dead-letter dashboard alert level."""
    p, r = _c(pending), _c(recent)
    return (F.when((p > 1000) | (r > 100), "CRITICAL").when((p > 100) | (r > 20), "WARNING")
            .when(p > 10, "INFO").otherwise("NORMAL"))


def rate_health(rate, bad: str = "DOWN", degraded: str = "DEGRADED", good: str = "UP") -> Column:
    """success-rate health: < 90 bad, < 99 degraded, else good."""
    r = _c(rate)
    return F.when(r < 90, bad).when(r < 99, degraded).otherwise(good)


def lag_level(lag, warning: int = 1000, critical: int = 10000) -> Column:
    """F8: per-partition lag level."""
    x = _c(lag)
    return F.when(x >= critical, "CRITICAL").when(x >= warning, "WARNING").otherwise("NORMAL")


# ------------------------------------------------------------------ SQL twins
def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _first_line_class_sql(m: str) -> str:
    return (f"regexp_extract(regexp_extract({m}, {_sq(FIRST_LINE_REGEX)}, 1), "
            f"{_sq(EXCEPTION_CLASS_REGEX)}, 1)")


def classify_error_sql(m: str) -> str:
    parts = [f"WHEN {m} IS NULL OR regexp_matches({m}, {_sq(BLANK_REGEX)}) THEN 'Unknown'"]
    parts += [f"WHEN contains(lower({m}), {_sq(p.lower())}) THEN {_sq(n)}" for p, n in ERROR_PATTERNS]
    cls = _first_line_class_sql(m)
    parts.append(f"WHEN {cls} <> '' THEN {cls}")
    return "(CASE " + " ".join(parts) + " ELSE 'Other Error' END)"


def classify_error_short_sql(m: str) -> str:
    cls = _first_line_class_sql(m)
    return (f"(CASE WHEN {m} IS NULL OR regexp_matches({m}, {_sq(BLANK_REGEX)}) THEN 'Unknown' "
            f"WHEN {cls} <> '' THEN {cls} ELSE 'Other' END)")


def alert_level_sql(p: str, r: str) -> str:
    return (f"(CASE WHEN {p} > 1000 OR {r} > 100 THEN 'CRITICAL' WHEN {p} > 100 OR {r} > 20 THEN 'WARNING' "
            f"WHEN {p} > 10 THEN 'INFO' ELSE 'NORMAL' END)")


def rate_health_sql(r: str, bad="DOWN", degraded="DEGRADED", good="UP") -> str:
    return f"(CASE WHEN {r} < 90 THEN '{bad}' WHEN {r} < 99 THEN '{degraded}' ELSE '{good}' END)"


def lag_level_sql(x: str, warning: int = 1000, critical: int = 10000) -> str:
    return f"(CASE WHEN {x} >= {critical} THEN 'CRITICAL' WHEN {x} >= {warning} THEN 'WARNING' ELSE 'NORMAL' END)"
