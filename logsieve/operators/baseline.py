"""Baselines of window features and the statistical detectors that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.parsing import exception_name, time_floor
from ..scratch import materialize
from .ordering import exact_quantiles
from .windows import WINDOW, WINDOW_FEATURES, long_features, with_window

QUANTILES = {"median": 0.5, "q25": 0.25, "q75": 0.75, "q95": 0.95}


def fit_baseline(features: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Mean, sample deviation and quartiles per feature, one row per feature; for tables of any size.

    The quantiles come from a distributed ranking, so no task holds all values of a feature.
    """
    cols = cols or WINDOW_FEATURES
    moments = long_features(features, cols).groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )
    quantiles = exact_quantiles(features, cols, list(QUANTILES.values()))
    wide = quantiles.groupBy("feature").agg(*[
        F.max(F.when(F.col("prob") == q, F.col("value"))).alias(name) for name, q in QUANTILES.items()
    ])
    return moments.join(wide, "feature")


#: The baseline of row-level data is the same table.
fit_row_baseline = fit_baseline


def zscore_anomalies(
    features: DataFrame, baseline: DataFrame, threshold: float = 3.0, cols: list[str] | None = None
) -> DataFrame:
    """Windows with at least one feature beyond the threshold; the score adds up those z-scores.

    The baseline is one row per feature: it is read once and becomes constants of the plan.
    """
    cols = cols or WINDOW_FEATURES
    known = {r["feature"]: r for r in baseline.filter(F.col("feature").isin(cols)).select("feature", "mean", "std").collect()}
    scored = []
    for name in cols:
        mean, std = (known[name]["mean"], known[name]["std"]) if name in known else (None, None)
        z = F.abs((F.col(name) - mean) / std) if mean is not None and std is not None and std > 0 else F.lit(None).cast("double")
        scored.append(F.struct(F.lit(name).alias("feature"), z.alias("z")))
    hits = F.filter(F.array(*scored), lambda x: x["z"] > threshold)
    return (
        features.withColumn("_hits", hits)
        .filter(F.size("_hits") > 0)
        .withColumn("anomaly_score", F.aggregate("_hits", F.lit(0.0), lambda acc, x: acc + x["z"]))
        .withColumn("reasons", F.array_join(
            F.transform("_hits", lambda x: F.format_string("%s: Z-score=%.2f", x["feature"], x["z"])), "; "
        ))
        .drop("_hits")
    )


def baseline_error_rate(baseline: DataFrame) -> Column:
    """Mean error rate of the baseline as a scalar."""
    return baseline.select(F.max(F.when(F.col("feature") == "error_rate", F.col("mean")))).scalar()


def error_spikes(features: DataFrame, baseline: DataFrame, multiplier: float = 5.0) -> DataFrame:
    """Windows whose error rate is more than ``multiplier`` times the baseline (at least 1 %)."""
    mean = F.coalesce(baseline_error_rate(baseline), F.lit(0.0))
    return (
        features.withColumn("baseline_error_rate", F.when(mean == 0, 0.01).otherwise(mean))
        .filter(F.col("error_rate") > F.col("baseline_error_rate") * multiplier)
        .select(
            WINDOW,
            "baseline_error_rate",
            F.col("error_rate").alias("current_error_rate"),
            (F.col("error_rate") / F.col("baseline_error_rate")).alias("multiplier"),
            "error_count",
            "total_logs",
        )
    )


def label_windows(features: DataFrame, baseline: DataFrame, factor: float = 2.0) -> DataFrame:
    """1 for windows whose error rate is above ``factor`` times the baseline."""
    limit = F.coalesce(baseline_error_rate(baseline), F.lit(0.0)) * factor
    return features.withColumn("true_label", (F.col("error_rate") > limit).cast("int"))


def error_concentration(logs: DataFrame, share: float = 0.5) -> DataFrame:
    """The class with most errors, if it has more than ``share`` of all errors."""
    return _concentration(logs.filter("is_error").groupBy("class_path").agg(F.count("*").alias("n")), share)


def _concentration(by_class: DataFrame, share: float) -> DataFrame:
    top = by_class.agg(
        F.min(F.struct((-F.col("n")).alias("n"), "class_path")).alias("top"), F.sum("n").alias("total_errors")
    )
    return top.select(
        F.lit("error_concentration").alias("type"),
        F.col("top.class_path").alias("class"),
        (-F.col("top.n")).alias("error_count"),
        "total_errors",
        (-F.col("top.n") / F.col("total_errors") * 100).alias("percentage"),
    ).filter(F.col("error_count") > F.col("total_errors") * share)


def frequency_anomalies(logs: DataFrame, width: str = "10 minutes", threshold: float = 3.0) -> DataFrame:
    """Windows with unusually many or few logs."""
    counts = with_window(logs, width).groupBy(WINDOW).agg(F.count("*").alias("log_count"))
    return _unusual_counts(materialize(counts, "window_counts"), threshold)


def _unusual_counts(counts: DataFrame, threshold: float) -> DataFrame:
    """From written (window, log_count) rows; mean and deviation are read once and become constants."""
    mean, std = counts.agg(F.avg("log_count"), F.stddev_samp("log_count")).first()
    usable = std is not None and std > 0
    z = F.abs((F.col("log_count") - F.lit(mean)) / F.lit(std)) if usable else F.lit(None).cast("double")
    return counts.select(
        F.lit("frequency_anomaly").alias("type"), WINDOW, "log_count", F.lit(mean).cast("double").alias("mean"), z.alias("z_score")
    ).filter(F.col("z_score") > threshold)


def exception_counts(logs: DataFrame) -> DataFrame:
    """Rows per first exception name."""
    return (
        logs.filter("has_exception")
        .select(exception_name(F.col("message")).alias("exception_type"))
        .filter(F.col("exception_type").isNotNull())
        .groupBy("exception_type")
        .agg(F.count("*").alias("count"))
    )


def rare_exceptions(logs: DataFrame, share: float = 0.01) -> DataFrame:
    """Exception names that make up less than ``share`` of all named exceptions."""
    return _rare(exception_counts(logs), share)


def _rare(counts: DataFrame, share: float) -> DataFrame:
    total = counts.select(F.sum("count")).scalar()
    return (
        counts.withColumn("_total", total)
        .filter(F.col("count") < F.col("_total") * share)
        .select(
            F.lit("new_exception_type").alias("type"),
            "exception_type",
            "count",
            (F.col("count") / F.col("_total") * 100).alias("percentage"),
        )
    )


def unusual_patterns(logs: DataFrame, width: str = "10 minutes") -> DataFrame:
    """The three pattern tables stacked; columns a pattern does not have are null.

    The lines are parsed once, into counts per (window, class, error, exception name).
    """
    window = F.when(F.col("timestamp").isNotNull(), time_floor("timestamp", width)).alias(WINDOW)
    name = F.when(F.col("has_exception"), exception_name(F.col("message"))).alias("exception_type")
    counts = materialize(
        logs.select(window, "class_path", "is_error", name).groupBy(WINDOW, "class_path", "is_error", "exception_type").agg(
            F.count("*").alias("n")), "patterns")
    by_class = counts.filter("is_error").groupBy("class_path").agg(F.sum("n").alias("n"))
    by_window = counts.filter(F.col(WINDOW).isNotNull()).groupBy(WINDOW).agg(F.sum("n").alias("log_count"))
    by_name = counts.filter(F.col("exception_type").isNotNull()).groupBy("exception_type").agg(F.sum("n").alias("count"))
    return (
        _concentration(by_class, 0.5)
        .unionByName(_unusual_counts(by_window, 3.0), allowMissingColumns=True)
        .unionByName(_rare(by_name, 0.01), allowMissingColumns=True)
    )


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: mean and population deviation of each column; a zero deviation counts as 1."""
    return df.agg(*[F.avg(c).alias(f"{c}_mean") for c in cols], *[F.stddev_pop(c).alias(f"{c}_std") for c in cols]).select(
        *[f"{c}_mean" for c in cols],
        *[F.when(F.col(f"{c}_std") == 0, 1.0).otherwise(F.col(f"{c}_std")).alias(f"{c}_std") for c in cols],
    )


def scale(df: DataFrame, scaler: DataFrame, cols: list[str]) -> DataFrame:
    """Standardised columns; nulls count as 0 before scaling.  The scaler's one row becomes constants."""
    row = scaler.select(*[f"{c}_{part}" for c in cols for part in ("mean", "std")]).first()

    def number(name: str) -> Column:
        return F.lit(None if row is None else row[name]).cast("double")

    return df.withColumns({
        c: (F.coalesce(F.col(c), F.lit(0)) - number(f"{c}_mean")) / number(f"{c}_std") for c in cols
    })


def flag_top(
    scored: DataFrame, training: DataFrame, score: str = "anomaly_score", contamination: float = 0.1
) -> DataFrame:
    """Flag scores above the ``1 - contamination`` quantile of the training scores, ranked in a distributed way."""
    limit = exact_quantiles(training, [score], [1 - contamination]).select("value").scalar()
    return scored.withColumn("is_anomaly", (F.col(score) > limit).cast("int"))
