"""Risk score of an anomalous sequence from its score, severity and text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import contains_any

# Words that point to a real problem.
CRITICAL_KEYWORDS = [
    "exception", "error", "failed", "timeout", "nullpointer", "outofmemory", "connection refused",
    "unauthorized", "forbidden", "sql injection", "xss", "csrf", "stacktrace", "traceback", "fatal",
    "critical", "panic", "crash", "hang", "deadlock", "out of memory", "memory leak", "disk full",
    "permission denied",
]
# Text of ordinary query and framework chatter.  One entry is in mixed case and cannot
# match lower-cased text; it is kept because the list is.
NORMAL_QUERY_PATTERNS = [
    "binding parameter", "==> parameters", "==>  preparing", "committing jdbc", "extracted value",
    "<==      total", "creating a new sqlsession", "closing non transactional", "jdbc connection",
    "hikariproxyconnection", "will not be managed", "registered for synchronization",
    "accept-language", "heartbeat status: 200", "discoveryclient", "channel=", "asynccommand",
    "write()", "completing command", "dispatching command", "decode done", "stack contains",
    "converted value on extraction", "doFilterInternal", "completed cache refresh",
    "got delta update", "config resolved", "pinning to endpoint", "total number of instances",
    "running with spring boot", "adding type registration",
]
# Text in which the word "error" reports that there was none.
FALSE_POSITIVE_PATTERNS = [
    "error='null'", "error=null", "error: 'null'", "error: null",
    "output=null", "output='null'", "output: null", "output: 'null'",
]
# Lower bounds of the risk buckets.
RISK_BOUNDS = [("CRITICAL", 80), ("HIGH", 60), ("MEDIUM", 40), ("LOW", 20)]
RISK_LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]


def is_normal_query(text: Column) -> Column:
    return contains_any(F.lower(text), NORMAL_QUERY_PATTERNS)


def is_false_positive(text: Column) -> Column:
    return contains_any(F.lower(text), FALSE_POSITIVE_PATTERNS)


def has_critical_keyword(text: Column) -> Column:
    return contains_any(F.lower(text), CRITICAL_KEYWORDS)


def has_real_exception(text: Column) -> Column:
    return has_critical_keyword(text) & ~is_false_positive(text)


def risk_score(anomaly: Column, severity: Column, text: Column) -> Column:
    """0 .. 150; only text with a real exception can pass 79."""
    normal, real = is_normal_query(text), has_real_exception(text)
    raw = (
        F.when(normal & ~real, F.least(F.lit(79.0), anomaly * 15 + severity))
        .when(real, anomaly * 60 + severity * 7)
        .otherwise(F.least(F.lit(79.0), anomaly * 25 + severity * 3))
    )
    return F.least(F.lit(150.0), F.greatest(F.lit(0.0), raw))


def risk_bucket(score: Column) -> Column:
    level = F
    for name, bound in RISK_BOUNDS:
        level = level.when(score >= bound, name)
    return level.otherwise("INFO")
