"""Runs of windows -> anomalous runs -> their logs, severity and priority."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..operators.detectors import temporal
from ..operators.severities import fill_severity, prioritize, severity_summary, with_score
from ..operators.severities import severity_aggs
from ..operators.windows import WINDOW, with_window


class Result(NamedTuple):
    sequences: DataFrame
    logs: DataFrame
    summary: DataFrame


def run_windows(anomalies: DataFrame) -> DataFrame:
    """One row per (run, window)."""
    return anomalies.select("sequence_index", F.explode("time_windows").alias(WINDOW))


def run_logs(anomalies: DataFrame, logs: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Logs of the windows of each run; a line in several runs appears once per run."""
    return with_window(logs, width).join(run_windows(anomalies), WINDOW)


def run_severity(anomalies: DataFrame, logs: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Severity of each run from per-window sums: the log lines are read once, not once per run."""
    aggs = {k: v for k, v in severity_aggs().items() if k != "avg_severity_score"}
    per_window = with_score(with_window(logs, width)).groupBy(WINDOW).agg(
        F.count("*").alias("log_count"), F.sum("severity_score").alias("_sum"), *[v.alias(k) for k, v in aggs.items()]
    )
    counts = [k for k in aggs if k.endswith("_count")]
    per_run = run_windows(anomalies).join(per_window, WINDOW).groupBy("sequence_index").agg(
        F.sum("log_count").alias("log_count"),
        F.max("max_severity_score").alias("max_severity_score"),
        (F.sum("_sum") / F.sum("log_count")).alias("avg_severity_score"),
        *[F.sum(c).alias(c) for c in counts],
    )
    return fill_severity(anomalies.join(per_run, "sequence_index", "left"))


def temporal_anomalies(
    features: DataFrame, logs: DataFrame, detector: str = "copod", w: int = 10, step: int = 1,
    width: str = "10 minutes", contamination: float = 0.1, train: DataFrame | None = None,
) -> Result:
    """Anomalous runs with severity and priority, their logs, and a summary.

    ``train``: window features to fit on; the first 80 % or another part of ``features``, or all of it.
    """
    runs = temporal.window_runs(features, w, step)
    base = runs if train is None else temporal.window_runs(train, w, step)
    scored = temporal.score(runs, temporal.fit(base, detector), contamination)
    found = scored.filter("is_anomaly = 1").select(
        "sequence_index", "time_windows",
        F.col("time_windows")[0].alias("start_time"),
        F.element_at("time_windows", -1).alias("end_time"),
        "anomaly_score",
    )
    ranked = prioritize(run_severity(found, logs, width))
    summary = severity_summary(ranked, "max_severity_level", "max_severity_score")
    return Result(ranked, run_logs(found, logs, width), summary)
