"""Numeric features of one log line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import SPACE_CHARS, stable_bucket

# Levels with a one-hot column, and words with a flag column.
FEATURE_LEVELS = ["DEBUG", "INFO", "WARN", "ERROR", "FATAL"]
FEATURE_KEYWORDS = [
    "exception", "error", "failed", "timeout", "connection", "null", "stack", "trace", "warning",
    "critical",
]

ROW_FEATURES = (
    [f"level_{name.lower()}" for name in FEATURE_LEVELS]
    + ["f_has_exception", "f_message_length", "pid_part", "class_bucket", "thread_bucket"]
    + [f"kw_{word}" for word in FEATURE_KEYWORDS]
    + ["word_count", "special_share"]
)


def pid_part(pid: Column) -> Column:
    """``pid % 1000 / 1000``: the last three digits decide; 0 for anything that is not a number."""
    return F.when(pid.rlike("^[0-9]+$"), F.right(pid, F.lit(3)).cast("int") / 1000).otherwise(F.lit(0.0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACE_CHARS}]+"))


def special_share(text: Column) -> Column:
    """Share of characters that are neither letters, digits nor a blank."""
    return F.length(F.regexp_replace(text, r"[\p{L}\p{N} ]+", "")) / F.greatest(F.length(text), F.lit(1))


def row_features(logs: DataFrame) -> DataFrame:
    """Append the 22 feature columns, all doubles."""
    text = F.lower("message")
    cols = {f"level_{name.lower()}": (F.col("level") == name) for name in FEATURE_LEVELS}
    cols["f_has_exception"] = F.col("has_exception")
    cols["f_message_length"] = F.col("message_length")
    cols["pid_part"] = pid_part(F.col("pid"))
    cols["class_bucket"] = stable_bucket(F.col("class_path")) / 1000
    cols["thread_bucket"] = stable_bucket(F.col("thread")) / 1000
    cols.update({f"kw_{word}": text.contains(word) for word in FEATURE_KEYWORDS})
    cols["word_count"] = word_count(text)
    cols["special_share"] = special_share(text)
    return logs.withColumns({name: cols[name].cast("double") for name in ROW_FEATURES})


def message_code(message: Column, width: int | None = None) -> Column:
    """Hash code of a message in [0, 1); repeated ``width`` times when an array is asked for."""
    code = stable_bucket(message) / 1000
    return code if width is None else F.array_repeat(code, width)
