"""Row-level comparison: split -> 22 features -> scaling -> detectors -> metrics and severity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.rowfeatures import ROW_FEATURES, row_features
from ..functions.severity import with_severity
from ..operators import baseline as B
from ..operators import evaluate as E
from ..operators.detectors import autoencoder, copod, iforest, lof, neighbour_forest, pca_recon, rff_ocsvm
from ..operators.severities import severity_summary
from ..operators.splits import split_nested
from ..scratch import materialize

KEY = "row_key"


def prepare(logs: DataFrame, split_rule: str = "is_error") -> DataFrame:
    """Scaled row features with ``split`` and a unique key; the scaler sees normal training rows only."""
    parted = split_nested(logs, split_rule=split_rule).withColumn(
        KEY, F.concat_ws(":", "file_path", F.col("line_number").cast("string"))
    )
    featured = materialize(row_features(parted), "rows")
    normal = featured.filter((F.col("split") == "train") & ~F.col("is_error"))
    return B.scale(featured, B.fit_scaler(normal, ROW_FEATURES), ROW_FEATURES)


def score(prepared: DataFrame, detector: str, contamination: float = 0.1) -> DataFrame:
    """Rows with ``anomaly_score`` and ``is_anomaly``, fitted on the normal training rows.

    The scores are written once; the threshold and the evaluation read them back.
    """
    normal = prepared.filter((F.col("split") == "train") & ~F.col("is_error"))
    if detector == "copod":
        marked = prepared.withColumn("_train", (F.col("split") == "train") & ~F.col("is_error"))
        scored = prepared.join(copod.score(marked, ROW_FEATURES, KEY, "_train"), KEY)
    elif detector == "isolation_forest":
        scored = iforest.score(prepared, iforest.fit(normal, ROW_FEATURES, KEY))
    elif detector == "autoencoder":
        scored = pca_recon.score(prepared, pca_recon.fit(normal, ROW_FEATURES))
    elif detector == "lof":
        mine = F.coalesce((F.col("split") == "train") & ~F.col("is_error"), F.lit(False))
        # training rows against each other, all others against them
        trees = neighbour_forest.TREES
        scored = lof.score(normal, ROW_FEATURES, trees=trees).unionByName(lof.score_new(prepared.filter(~mine), normal, ROW_FEATURES, trees=trees))
    elif detector == "neural_autoencoder":
        scored = autoencoder.score(prepared, autoencoder.fit(normal, ROW_FEATURES))
    elif detector == "ocsvm":
        scored = rff_ocsvm.score(prepared, rff_ocsvm.fit(normal, ROW_FEATURES))
    else:
        raise ValueError(f"unknown detector {detector!r}")
    slim = scored.select(KEY, "split", "is_error", "level", "message", "anomaly_score")
    scored = materialize(slim, "row_scores")
    training = scored.filter((F.col("split") == "train") & ~F.col("is_error"))
    return B.flag_top(scored, training, contamination=contamination)


def evaluate(prepared: DataFrame, detectors: tuple[str, ...] = ("isolation_forest", "autoencoder")) -> DataFrame:
    """Metrics and AUC on the test rows, one row per detector."""
    parts = [
        score(prepared, name).filter(F.col("split") == "test").select(
            F.lit(name).alias("model"), F.col("is_error").cast("int").alias("y_true"),
            F.col("is_anomaly").alias("y_pred"), "anomaly_score",
        )
        for name in detectors
    ]
    rows = reduce(DataFrame.unionByName, parts)
    return E.compare_models(
        E.classification_metrics(rows, ["model"]).join(E.roc_auc(rows, ["model"]), "model", "left")
    )


def detected_severity(prepared: DataFrame, detector: str) -> DataFrame:
    """Severity summary of the test rows a detector flags."""
    flagged = score(prepared, detector).filter((F.col("split") == "test") & (F.col("is_anomaly") == 1))
    return severity_summary(with_severity(flagged.select("level", "message")))
