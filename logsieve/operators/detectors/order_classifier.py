"""Sequence classifier that sees the order: pooled template vectors and a logistic regression on both labels.

Each template has a vector of what it precedes and of what it follows.  A sequence is described by their mean, their
means weighted towards its end, and the products over neighbouring lines (what usually comes in this order counts up,
the reverse doesn't).  These are sums of shifted copies of a bucket's rows, one numpy step per bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from ..embedding import template_embedding
from ..ordering import row_count
from ..sequences import BUCKET, BUCKET_ROWS, with_forward_halo


@dataclass
class Fitted:
    """``vectors``: (template, before, after); a sequence is positive with the logistic of ``weights`` and ``intercept``."""

    vectors: DataFrame
    dims: int
    weights: list[float]
    intercept: float
    w: int


def _pooled(indexed: DataFrame, vectors: DataFrame, dims: int, w: int, bucket_rows: int) -> DataFrame:
    """(sequence_index, label, features) of every sequence of ``w`` rows."""
    n = row_count(indexed)
    rows = indexed.select("idx", "template", "is_error").join(vectors, "template", "left")
    halo = with_forward_halo(rows, w, bucket_rows=bucket_rows).select(BUCKET, "idx", "is_error", "before", "after")
    size = max(bucket_rows, w)

    def pool(batch: pa.Table) -> pa.Table:
        batch = batch.combine_chunks().sort_by("idx")
        idx = batch["idx"].to_numpy()
        starts = max(len(idx) - w + 1, 0)
        before, after = (_dense(batch[c].combine_chunks(), dims) for c in ("before", "after"))
        both = np.hstack([before, after])
        ordered = before[:-1] * after[1:]
        mean, late, pairs = np.zeros((starts, 2 * dims)), np.zeros((starts, 2 * dims)), np.zeros((starts, dims))
        for k in range(w):
            mean += both[k:k + starts]
            late += both[k:k + starts] * (2 * k / max(w - 1, 1) - 1)
            if k < w - 1:
                pairs += ordered[k:k + starts]
        errors = np.concatenate([[0], np.cumsum(batch["is_error"].to_numpy().astype(int))])
        label = (errors[w:] > errors[:-w] if starts else errors[:0]).astype(float)
        own = idx[:starts] // size == (batch[BUCKET][0].as_py() if len(idx) else 0)
        flat = np.hstack([mean, late, pairs])[own] / w
        at = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1])
        return pa.table({"sequence_index": idx[:starts][own], "label": label[own], "features": pa.ListArray.from_arrays(at, pa.array(flat.ravel()))})

    pooled = halo.groupBy(BUCKET).applyInArrow(pool, "sequence_index long, label double, features array<double>")
    return pooled.filter(F.col("sequence_index") <= n - w)


def _dense(vectors: pa.ListArray, dims: int) -> np.ndarray:
    """A row per vector, zeros for a missing one."""
    out = np.zeros((len(vectors), dims))
    if dims:
        out[vectors.is_valid().to_numpy(zero_copy_only=False)] = vectors.flatten().to_numpy().reshape(-1, dims)
    return out


def fit(
    indexed: DataFrame, w: int = 15, dims: int = 16, max_iter: int = 50, reg: float = 1e-4, bucket_rows: int = BUCKET_ROWS,
) -> Fitted:
    """``indexed``: rows with ``idx``, ``template`` and ``is_error``; a sequence with an error is positive."""
    vectors, dims = template_embedding(indexed, dims, bucket_rows=bucket_rows)
    data = _pooled(indexed, vectors, dims, w, bucket_rows).select("label", array_to_vector("features").alias("features"))
    model = LogisticRegression(maxIter=max_iter, regParam=reg).fit(data)
    return Fitted(vectors, dims, model.coefficients.toArray().tolist(), float(model.intercept), w)


def score(indexed: DataFrame, fitted: Fitted, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    pooled = _pooled(indexed, fitted.vectors, fitted.dims, fitted.w, bucket_rows)
    weights = F.array(*map(F.lit, fitted.weights)) if fitted.weights else F.array().cast("array<double>")
    product = F.aggregate(F.zip_with("features", weights, lambda x, y: x * y), F.lit(fitted.intercept), lambda a, x: a + x)
    return pooled.select("sequence_index", (1 / (1 + F.exp(-product))).alias("anomaly_score"))


def detect(indexed: DataFrame, fitted: Fitted, threshold: float = 0.5, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    return score(indexed, fitted, bucket_rows).filter(F.col("anomaly_score") > threshold).withColumn(
        "is_anomaly", F.lit(True)
    )
