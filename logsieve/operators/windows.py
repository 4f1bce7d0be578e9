"""Features of fixed time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.parsing import time_floor
from ..functions.text import stable_bucket
from ..scratch import materialize
from .ordering import exact_quantiles

# Numeric window features in the order in which reasons are listed.
WINDOW_FEATURES = [
    "total_logs", "error_count", "warn_count", "error_rate", "warn_rate", "unique_classes",
    "unique_threads", "avg_message_length", "exception_count", "exception_rate", "unique_files",
    "info_count", "debug_count", "top_class_count", "top_class_hash",
]
WINDOW = "time_window"


def with_window(logs: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Logs with the start of their window; lines without a valid time are left out."""
    return logs.filter(F.col("timestamp").isNotNull()).withColumn(WINDOW, time_floor("timestamp", width))


def window_features(logs: DataFrame, width: str = "10 minutes") -> DataFrame:
    """One row per non-empty window.

    Rows are first summed per combination of the counted columns: the exact distinct counts and the top
    class then work on that much smaller table, and a window with a huge share of the rows is spread
    over many combinations.  ``error_count`` counts the level ERROR while ``error_rate`` is the share of
    ``is_error`` rows, whose count is kept as ``is_error_count``.
    """
    combos = materialize(with_window(logs, width).groupBy(WINDOW, "class_path", "thread", "file_path", "level").agg(
        F.count("*").alias("n"),
        F.count_if("is_error").alias("errors"),
        F.count_if("has_exception").alias("exceptions"),
        F.sum(F.col("message_length").cast("long")).alias("chars"),
    ), "combos")  # written, so that the sums and the top class share one pass over the text
    n = F.sum("n")

    def level_rows(level: str):
        return F.sum(F.when(F.col("level") == level, F.col("n")).otherwise(0))

    sums = combos.groupBy(WINDOW).agg(
        n.alias("total_logs"),
        level_rows("ERROR").alias("error_count"),
        level_rows("WARN").alias("warn_count"),
        (F.sum("errors") / n).alias("error_rate"),
        (level_rows("WARN") / n).alias("warn_rate"),
        F.count_distinct("class_path").alias("unique_classes"),
        F.count_distinct("thread").alias("unique_threads"),
        (F.sum("chars") / n).alias("avg_message_length"),
        F.sum("exceptions").alias("exception_count"),
        (F.sum("exceptions") / n).alias("exception_rate"),
        F.count_distinct("file_path").alias("unique_files"),
        level_rows("INFO").alias("info_count"),
        level_rows("DEBUG").alias("debug_count"),
        F.sum("errors").alias("is_error_count"),
    )
    return (
        sums.join(_top_class(combos), WINDOW)
        .withColumn("top_class_hash", stable_bucket(F.col("top_class")))
        .select(WINDOW, *WINDOW_FEATURES, "is_error_count", "top_class")
    )


def _top_class(combos: DataFrame) -> DataFrame:
    by_class = combos.groupBy(WINDOW, "class_path").agg(F.sum("n").alias("n"))
    first = F.min(F.struct((-F.col("n")).alias("n"), "class_path"))
    return by_class.groupBy(WINDOW).agg(first.alias("_top")).select(
        WINDOW,
        F.col("_top.class_path").alias("top_class"),
        (-F.col("_top.n")).alias("top_class_count"),
    )


def top_class(logs: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Most frequent class of each window; the smallest name wins a tie."""
    return _top_class(
        with_window(logs, width).groupBy(WINDOW, "class_path").agg(F.count("*").alias("n"))
    )


def level_counts(logs: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Rows per window for each of the four counted levels."""
    return with_window(logs, width).groupBy(WINDOW).agg(
        *[F.count_if(F.col("level") == v).alias(f"{v.lower()}_count") for v in ("ERROR", "WARN", "INFO", "DEBUG")]
    )


def load_summary(logs: DataFrame) -> DataFrame:
    """Row count, time range, error and warning counts."""
    return logs.agg(
        F.count("*").alias("total_logs"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
        F.count_if("is_error").alias("error_logs"),
        F.count_if(F.col("level") == "WARN").alias("warn_logs"),
    )


def level_distribution(logs: DataFrame) -> DataFrame:
    """Rows and share per level."""
    counts = logs.groupBy("level").agg(F.count("*").alias("n"))
    total = counts.select(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def describe_features(features: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Count, mean, std, min, quartiles and max of each feature, one row per feature."""
    cols = cols or WINDOW_FEATURES
    moments = _long(features, cols).groupBy("feature").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(features, cols, [0.25, 0.5, 0.75])
    wide = quartiles.groupBy("feature").agg(*[
        F.max(F.when(F.col("prob") == q, F.col("value"))).alias(name) for q, name in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))
    ])
    return moments.join(wide, "feature", "left").select("feature", "count", "mean", "std", "min", "q25", "median", "q75", "max")


def _long(df: DataFrame, cols: list[str], *keys: str) -> DataFrame:
    return df.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols
    ])))


def long_features(df: DataFrame, cols: list[str], *keys: str) -> DataFrame:
    """(keys, feature, value) rows."""
    return _long(df, cols, *keys)
