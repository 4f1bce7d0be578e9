"""Severity of groups of log lines, priorities and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.severity import severity_bucket, severity_score, with_severity
from .ordering import rank_rows
from .sequences import BUCKET_ROWS, for_sequences
from .windows import WINDOW, with_window

COUNTED = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]


def severity_aggs(score: str = "severity_score") -> dict[str, Column]:
    """Aggregates that describe the severity of a group of rows."""
    s = F.col(score)
    aggs = {"max_severity_score": F.max(s), "avg_severity_score": F.avg(s)}
    for name in COUNTED:
        aggs[f"{name.lower()}_count"] = F.count_if(s.isNotNull() & (severity_bucket(s) == name))
    return aggs


SEVERITY_COLUMNS = [
    "max_severity_score", "max_severity_level", "avg_severity_score",
    *[f"{name.lower()}_count" for name in COUNTED],
]


def fill_severity(df: DataFrame) -> DataFrame:
    """A group without rows has severity 0 / INFO and no counts; adds the bucket of the maximum."""
    filled = df.withColumns({
        c: F.coalesce(F.col(c), F.lit(0)) for c in SEVERITY_COLUMNS if c != "max_severity_level"
    })
    return filled.withColumn("max_severity_level", severity_bucket(F.col("max_severity_score")))


def with_score(logs: DataFrame) -> DataFrame:
    """Logs with the row severity score only."""
    return logs.withColumn("severity_score", severity_score(F.col("level"), F.col("message")))


def severity_agg(logs: DataFrame, keys: list[str]) -> DataFrame:
    """Severity per group; pre-aggregated on the map side."""
    aggs = severity_aggs()
    grouped = with_score(logs).groupBy(*keys).agg(*[a.alias(k) for k, a in aggs.items()])
    return fill_severity(grouped).select(*keys, *SEVERITY_COLUMNS)


def attach_window_severity(results: DataFrame, logs: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Severity of the logs of each result window; windows without logs get 0 / INFO.

    A result column of the same name (``info_count`` of the window features) is replaced.
    """
    per_window = severity_agg(with_window(logs, width), [WINDOW])
    return fill_severity(results.drop(*SEVERITY_COLUMNS).join(per_window, WINDOW, "left"))


def attach_severity(results: DataFrame, logs: DataFrame, width: str = "10 minutes") -> DataFrame:
    """By window if the result has windows, by row if it has log lines, else unchanged."""
    if WINDOW in results.columns:
        return attach_window_severity(results, logs, width)
    if {"level", "message"} <= set(results.columns):
        return with_severity(results)
    return results


def attach_sequence_severity(
    anomalies: DataFrame, indexed: DataFrame, w: int = 15, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Severity of the ``w`` rows of each anomalous sequence, in one shuffle of the rows."""
    rows = with_score(indexed.select("idx", "level", "message")).select("idx", "severity_score")
    return fill_severity(for_sequences(anomalies, rows, w, severity_aggs(), bucket_rows=bucket_rows))


def prioritize(df: DataFrame, score: str = "max_severity_score", tie: tuple[str, ...] = ("sequence_index",)) -> DataFrame:
    """1..n by severity, then by anomaly score, then by the unique tie columns."""
    keys = [F.col(score).desc_nulls_last()]
    if "anomaly_score" in df.columns:
        keys.append(F.col("anomaly_score").desc_nulls_last())
    return rank_rows(df, [*keys, *tie])


def severity_summary(df: DataFrame, level: str = "severity_level", score: str = "severity_score") -> DataFrame:
    """One row: total, count per bucket, mean and maximum."""
    return df.agg(
        F.count("*").alias("total_anomalies"),
        *[F.count_if(F.col(level) == name).alias(f"{name.lower()}_count") for name in COUNTED],
        F.avg(score).alias("avg_severity_score"),
        F.max(score).alias("max_severity_score"),
    )


def top_exceptions(df: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent exception types."""
    return (
        df.filter(F.col("exception_type").isNotNull())
        .groupBy("exception_type")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "exception_type")
        .limit(k)
    )
