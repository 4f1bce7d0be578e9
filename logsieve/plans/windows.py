"""Window analysis: features -> time split -> baseline and detectors -> anomalies with severity."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..operators import baseline as B
from ..operators.detectors import autoencoder, copod, iforest, lof, pca_recon, rff_ocsvm
from ..operators.evaluate import classification_metrics
from ..operators.ordering import PART, POS, exact_quantiles, lay_out, number_rows
from ..operators.severities import attach_severity
from ..operators.splits import split_by_time
from ..operators.windows import WINDOW, WINDOW_FEATURES, window_features
from ..scratch import materialize


@dataclass
class State:
    """Everything needed to score later logs."""

    baseline: DataFrame
    scaler: DataFrame
    models: dict[str, Any] = field(default_factory=dict)
    limits: dict[str, DataFrame] = field(default_factory=dict)
    width: str = "10 minutes"


def split_features(features: DataFrame, shares: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """Window features with their position in time and train / valid / test."""
    return split_by_time(number_rows(lay_out(features, [WINDOW], "windows")), shares).drop(PART, POS)


def fit(features: DataFrame, detectors: tuple[str, ...] = ("isolation_forest", "autoencoder"),
        contamination: float = 0.1, width: str = "10 minutes") -> State:
    """Baseline, scaler and detectors from training windows; a detector that can't be fitted raises."""
    scaler = B.fit_scaler(features, WINDOW_FEATURES)
    state = State(B.fit_baseline(features), scaler, width=width)
    scaled = B.scale(features, scaler, WINDOW_FEATURES)
    for name in detectors:
        model = _fit_one(name, scaled)
        state.models[name] = model
        own = _train_scores(name, scaled, model)
        state.limits[name] = exact_quantiles(own, ["anomaly_score"], [1 - contamination]).select(F.col("value").alias("limit"))
    return state


def _fit_one(name: str, scaled: DataFrame):
    if name == "isolation_forest":
        return iforest.fit(scaled, WINDOW_FEATURES, WINDOW)
    if name == "autoencoder":
        return pca_recon.fit(scaled, WINDOW_FEATURES)
    if name == "neural_autoencoder":
        return autoencoder.fit(scaled, WINDOW_FEATURES)
    if name == "ocsvm":
        return rff_ocsvm.fit(scaled, WINDOW_FEATURES)
    if name in ("lof", "copod"):  # the fitted state of both is the training windows
        return materialize(scaled.select(WINDOW, *WINDOW_FEATURES), f"{name}_train")
    raise KeyError(f"unknown detector {name!r}")


def _score_one(name: str, scaled: DataFrame, model) -> DataFrame:
    if name == "isolation_forest":
        return iforest.score(scaled, model)
    if name == "autoencoder":
        return pca_recon.score(scaled, model)
    if name == "neural_autoencoder":
        return autoencoder.score(scaled, model)
    if name == "ocsvm":
        return rff_ocsvm.score(scaled, model)
    if name == "lof":
        return lof.score_new(scaled, model, WINDOW_FEATURES)
    return scaled.join(copod.score_new(scaled, model, WINDOW_FEATURES, WINDOW), WINDOW)


def _train_scores(name: str, scaled: DataFrame, model) -> DataFrame:
    """Scores of the training windows themselves; for the outlier factor each against the others."""
    if name == "lof":
        return lof.score(scaled, WINDOW_FEATURES)
    return _score_one(name, scaled, model)


def score_model(features: DataFrame, state: State, name: str) -> DataFrame:
    """Features with ``anomaly_score`` and ``is_anomaly`` of one fitted detector."""
    scores = _score_one(name, B.scale(features, state.scaler, WINDOW_FEATURES), state.models[name])
    limit = state.limits[name].select("limit").scalar()
    return features.join(scores.select(WINDOW, "anomaly_score"), WINDOW).withColumn(
        "is_anomaly", (F.col("anomaly_score") > limit).cast("int")
    )


def detect_all(features: DataFrame, logs: DataFrame, state: State, severity: bool = False) -> dict[str, DataFrame]:
    """Named results of all detectors: windows for most, pattern rows over all logs for one."""
    results = {
        "zscore": B.zscore_anomalies(features, state.baseline),
        "error_spikes": B.error_spikes(features, state.baseline),
        "unusual_patterns": B.unusual_patterns(logs, state.width),
    }
    for name in state.models:
        results[name] = score_model(features, state, name).filter("is_anomaly = 1")
    if severity:
        results = {
            k: v if k == "unusual_patterns" else attach_severity(v, logs, state.width) for k, v in results.items()
        }
    return results


def detect_new(logs: DataFrame, state: State, severity: bool = False) -> dict[str, DataFrame]:
    """Score new logs with what was fitted before; the features are written once for all detectors."""
    features = materialize(window_features(logs, state.width), "features")
    return detect_all(features, logs, state, severity)


def validate(features: DataFrame, state: State, name: str) -> DataFrame:
    """Metrics of one detector against the error-rate label; no row when both sides have one class only."""
    labelled = B.label_windows(score_model(features, state, name), state.baseline)
    return classification_metrics(labelled, y="true_label", pred="is_anomaly").filter(
        ~(((F.col("tp") + F.col("fn") == 0) | (F.col("tn") + F.col("fp") == 0))
          & ((F.col("tp") + F.col("fp") == 0) | (F.col("tn") + F.col("fn") == 0)))
    )


def save(state: State, path: str, mode: str = "errorifexists") -> None:
    """Tables as Parquet; fitted detectors as one-row tables of their arrays."""
    import json
    from dataclasses import asdict

    import numpy as np

    from ..sources.sinks import save_state

    spark = state.baseline.sparkSession

    def plain(v):
        return v.tolist() if isinstance(v, np.ndarray) else v

    models = [
        (name, json.dumps({k: plain(v) for k, v in asdict(m).items()} if not isinstance(m, DataFrame) else None))
        for name, m in state.models.items()
    ]
    tables = {
        "baseline": state.baseline,
        "scaler": state.scaler,
        "settings": spark.createDataFrame([(state.width,)], "width string"),
        "models": spark.createDataFrame(models, "name string, parameters string"),
    }
    for name, limit in state.limits.items():
        tables[f"limit_{name}"] = limit
        if isinstance(state.models[name], DataFrame):
            tables[f"train_{name}"] = state.models[name]
    save_state(tables, path, mode)


def load(spark, path: str) -> State:
    import json

    import numpy as np

    from ..sources.sinks import load_state

    tables = load_state(spark, path)
    state = State(tables["baseline"], tables["scaler"], width=tables["settings"].first()["width"])
    for row in tables["models"].collect():
        values = json.loads(row["parameters"])
        if row["name"] == "isolation_forest":
            arrays = {k: np.array(values[k]) for k in ("feature", "threshold", "left", "depth")}
            model = iforest.Fitted(**arrays, sample=values["sample"], cols=values["cols"])
        elif row["name"] == "autoencoder":
            model = pca_recon.Fitted(**values)
        elif row["name"] == "neural_autoencoder":
            model = autoencoder.Fitted(**values)
        elif row["name"] == "ocsvm":
            arrays = {k: np.array(values[k]) for k in ("mean", "std", "freq", "phase", "weights")}
            model = rff_ocsvm.Fitted(values["cols"], offset=values["offset"], **arrays)
        else:
            model = tables[f"train_{row['name']}"]
        state.models[row["name"]] = model
        state.limits[row["name"]] = tables[f"limit_{row['name']}"]
    return state
