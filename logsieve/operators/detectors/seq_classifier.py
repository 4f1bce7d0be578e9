"""Sequence classifier: hashed template counts of a sequence and a logistic regression on both labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ...scratch import materialize
from ..sequences import BUCKET_ROWS, over_sequences


@dataclass
class Fitted:
    model: LogisticRegressionModel
    w: int
    buckets: int


def _vectors(indexed: DataFrame, w: int, buckets: int, bucket_rows: int) -> DataFrame:
    packed = over_sequences(
        indexed.select("idx", "template", "is_error"), w,
        {"templates": F.collect_list("template"), "label": F.max(F.col("is_error").cast("double"))},
        bucket_rows=bucket_rows,
    )
    return HashingTF(inputCol="templates", outputCol="features", numFeatures=buckets).transform(packed)


def fit(
    indexed: DataFrame, w: int = 15, buckets: int = 256, max_iter: int = 20, reg: float = 1e-3,
    bucket_rows: int = BUCKET_ROWS,
) -> Fitted:
    """``indexed``: rows with ``idx``, ``template`` and ``is_error``; a sequence with an error is positive."""
    # the regression reads its rows twice before it keeps them: once for their moments, once to pack them
    data = materialize(_vectors(indexed, w, buckets, bucket_rows).select("features", "label"), "counts")
    return Fitted(LogisticRegression(maxIter=max_iter, regParam=reg).fit(data), w, buckets)


def score(indexed: DataFrame, fitted: Fitted, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    scored = fitted.model.transform(_vectors(indexed, fitted.w, fitted.buckets, bucket_rows))
    return scored.select("sequence_index", vector_to_array("probability")[1].alias("anomaly_score"))


def detect(indexed: DataFrame, fitted: Fitted, threshold: float = 0.5, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    return score(indexed, fitted, bucket_rows).filter(F.col("anomaly_score") > threshold).withColumn(
        "is_anomaly", F.lit(True)
    )
