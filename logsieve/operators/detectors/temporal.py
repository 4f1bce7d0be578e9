"""Anomalies in runs of time windows: the features of ``w`` windows in a row, flattened, form one case."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ...scratch import materialize
from ..baseline import flag_top
from ..ordering import lay_out, number_rows
from ..sequences import BUCKET_ROWS, over_sequences
from ..windows import WINDOW, WINDOW_FEATURES
from . import copod, iforest, lof, pca_recon

KEY, FLAT = "sequence_index", "flat"


def window_runs(
    features: DataFrame, w: int = 10, step: int = 1, cols: list[str] | None = None, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """(sequence_index, time_windows, flat): ``w`` windows per run, features flattened in time order."""
    cols = cols or WINDOW_FEATURES
    indexed = number_rows(lay_out(features, [WINDOW], "windows"))
    packed = over_sequences(
        indexed, w,
        {
            "time_windows": F.collect_list(WINDOW),
            FLAT: F.collect_list(F.array(*[F.col(c).cast("double") for c in cols])),
        },
        bucket_rows=bucket_rows,
    )
    stepped = packed if step == 1 else packed.filter(F.pmod(KEY, F.lit(step)) == 0)
    return stepped.withColumn(FLAT, F.flatten(FLAT))


def long_runs(runs: DataFrame) -> DataFrame:
    """(sequence_index, feature, value): ``feature`` is the position in the flattened run."""
    return runs.select(KEY, F.posexplode(FLAT).alias("feature", "value"))


def fit_run_scaler(runs: DataFrame) -> DataFrame:
    """One row with the means and population deviations of all positions, in order."""
    moments = long_runs(runs).groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )
    ordered = moments.agg(F.array_sort(F.collect_list(F.struct("feature", "mean", "std"))).alias("m"))
    return ordered.select(
        F.transform("m", lambda x: x["mean"]).alias("mean"),
        F.transform("m", lambda x: F.when(x["std"] == 0, 1.0).otherwise(x["std"])).alias("std"),
    )


def scale_runs(runs: DataFrame, scaler: DataFrame) -> DataFrame:
    params = scaler.select(F.struct("mean", "std")).scalar()
    return runs.withColumn("_s", params).withColumn(
        FLAT, F.transform(FLAT, lambda x, i: (x - F.col("_s.mean")[i]) / F.col("_s.std")[i])
    ).drop("_s")


def run_columns(runs: DataFrame, width: int) -> DataFrame:
    """Runs with one column per position, for detectors that take columns."""
    return runs.select(KEY, "time_windows", *[F.col(FLAT)[i].alias(f"f{i}") for i in range(width)])


@dataclass
class Fitted:
    """``scaler``: one row of means and deviations; ``model``: the fitted detector, if it needs a fit."""

    detector: str
    width: int
    scaler: DataFrame
    model: Any
    training: DataFrame


def fit(runs: DataFrame, detector: str = "copod") -> Fitted:
    if detector not in ("copod", "lof", "isolation_forest", "autoencoder"):
        raise ValueError(f"unknown detector {detector!r}")
    if detector == "copod":
        return Fitted(detector, 0, None, None, runs)  # ranks do not depend on the scale
    width = runs.select(F.size(FLAT).alias("n")).first()["n"]
    scaler = fit_run_scaler(runs)
    model, cols = None, [f"f{i}" for i in range(width)]
    if detector != "lof":
        scaled = materialize(run_columns(scale_runs(runs, scaler), width), "runs")
        model = iforest.fit(scaled, cols, KEY) if detector == "isolation_forest" else pca_recon.fit(scaled, cols)
    return Fitted(detector, width, scaler, model, runs)


def _scores(runs: DataFrame, fitted: Fitted) -> DataFrame:
    own = runs is fitted.training
    if fitted.detector == "copod":
        if own:
            return runs.join(copod.score_long(long_runs(runs), KEY), KEY)
        both = long_runs(runs).withColumn("_train", F.lit(False)).unionByName(
            long_runs(fitted.training).withColumn("_train", F.lit(True))
        )
        return runs.join(copod.score_long(both, KEY, "_train", only_new=True), KEY)
    scaled = run_columns(scale_runs(runs, fitted.scaler), fitted.width)
    if fitted.detector == "isolation_forest":
        return iforest.score(scaled, fitted.model)
    if fitted.detector == "autoencoder":
        return pca_recon.score(scaled, fitted.model)
    cols = [f"f{i}" for i in range(fitted.width)]
    if own:
        return lof.score(scaled, cols)
    return lof.score_new(scaled, run_columns(scale_runs(fitted.training, fitted.scaler), fitted.width), cols)


def score(runs: DataFrame, fitted: Fitted, contamination: float = 0.1) -> DataFrame:
    """(sequence_index, time_windows, anomaly_score, is_anomaly)."""
    slim = [KEY, "time_windows", "anomaly_score"]
    scored = materialize(_scores(runs, fitted).select(*slim), "run_scores")
    training = scored if runs is fitted.training else _scores(fitted.training, fitted).select(*slim)
    return flag_top(scored, training, contamination=contamination)
