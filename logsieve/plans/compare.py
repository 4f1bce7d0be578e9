"""Comparison of sequence models on held-out lines."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..operators import evaluate as E
from ..operators.sequences import spread_scores
from ..operators.splits import number_nested
from ..operators.vocabulary import with_template
from ..scratch import materialize
from . import sequences as P

COLUMNS = ["timestamp", "file_path", "line_number", "level", "message", "is_error", "template"]


class Data(NamedTuple):
    train: DataFrame
    valid: DataFrame
    test: DataFrame


def prepare(logs: DataFrame, train: float = 0.8, valid: float = 0.2, split_rule: str = "is_error") -> Data:
    """Nested split; every part with ``idx`` in time order, and ``class_idx`` within its class."""
    written = materialize(number_nested(with_template(logs).select(*COLUMNS), train, valid, split_rule), "nested")
    return Data(*[written.filter(F.col("split") == s) for s in ("train", "valid", "test")])


def predict(test: DataFrame, fitted, w: int = P.WIDTH, mark: str = "sequence") -> DataFrame:
    """(idx, y_true, y_pred, anomaly_score) per line from the flagged sequences.

    When nothing is flagged, no line is predicted and the scores of all sequences are spread instead.
    ``mark="sequence"`` marks all lines from the start of a sequence on; ``mark="target"`` marks, for the
    next-template model, only the line that was predicted.
    """
    flagged = materialize(P.detect(test, fitted).select("sequence_index", "anomaly_score"), "flagged")
    if flagged.isEmpty():
        return predict_raw(test, fitted, w)
    span = w
    if mark == "target":
        flagged, span = flagged.withColumn("sequence_index", F.col("sequence_index") + w), 1
    labels = test.select("idx", F.col("is_error").cast("int").alias("y_true"))
    return labels.join(spread_scores(test, flagged, span), "idx")


def predict_raw(test: DataFrame, fitted, w: int = P.WIDTH) -> DataFrame:
    """The same with the scores of all sequences, for models that flag nothing."""
    labels = test.select("idx", F.col("is_error").cast("int").alias("y_true"))
    spread = spread_scores(test, P.scores(test, fitted), w).withColumn("y_pred", F.lit(0))
    return labels.join(spread, "idx")


def apply_best_threshold(predictions: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """Predictions at the best balanced threshold; unchanged where none meets the minima."""
    goal = targets or E.TARGETS
    best = E.best_threshold(predictions, "balanced", goal["precision"], goal["recall"])
    limit = best.select(F.when(F.col("f1").isNotNull(), F.col("threshold"))).scalar()
    tuned = F.when(limit.isNull(), F.col("y_pred")).otherwise((F.col("anomaly_score") >= limit).cast("int"))
    return predictions.withColumn("y_pred", tuned)


def evaluate(predictions: dict[str, DataFrame], optimize_threshold: bool = True, targets: dict[str, float] | None = None) -> DataFrame:
    """One row of metrics per model, with the target check and the weighted total."""
    tuned = {k: apply_best_threshold(v, targets) if optimize_threshold else v for k, v in predictions.items()}
    rows = reduce(DataFrame.unionByName, [
        df.select(F.lit(name).alias("model"), "y_true", "y_pred", "anomaly_score") for name, df in tuned.items()
    ])
    metrics = E.classification_metrics(rows, ["model"]).join(E.roc_auc(rows, ["model"]), "model", "left")
    return E.with_total(E.meets_target(metrics, targets))


def compare(logs: DataFrame, detectors: tuple[str, ...] = ("ngram", "tfidf"), w: int = P.WIDTH, split_rule: str = "is_error") -> DataFrame:
    """Fit on the normal training lines, predict the test lines, evaluate and rank."""
    data = prepare(logs, split_rule=split_rule)
    normal = data.train.filter(~F.col("problem")).drop("idx").withColumnRenamed("class_idx", "idx")
    predictions = {}
    for name in detectors:
        # the classifiers need both labels
        fitted = P.fit(data.train if name in P.BOTH_LABELS else normal, name, w)
        # written once: threshold search, metrics and AUC all read it
        predictions[name] = materialize(predict(data.test, fitted, w), "predictions")
    return E.compare_models(evaluate(predictions))
