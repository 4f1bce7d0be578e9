"""Reconstruction error of a linear auto-encoder (principal components).

Stands for a neural auto-encoder: the bottleneck follows the same size rule, narrowed to half of the
inputs so that something is left to lose, and fewer than 10 rows are refused.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from ..baseline import fit_scaler

MIN_ROWS = 10


@dataclass
class Fitted:
    cols: list[str]
    mean: list[float]
    std: list[float]
    axes: list[list[float]]  # one list per component


def bottleneck(features: int) -> int:
    """Width of the narrowest layer for a number of input features."""
    narrow = max(2, features // 2) if features <= 5 else 8 if features <= 10 else 16
    return max(1, min(narrow, features // 2))


def fit(df: DataFrame, cols: list[str], components: int | None = None) -> Fitted:
    if len(df.limit(MIN_ROWS).take(MIN_ROWS)) < MIN_ROWS:
        raise ValueError(f"at least {MIN_ROWS} rows are needed")
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    row = fit_scaler(filled, cols).first()
    mean, std = [row[f"{c}_mean"] for c in cols], [row[f"{c}_std"] for c in cols]
    scaled = filled.select(*[((F.col(c) - m) / s).alias(c) for c, m, s in zip(cols, mean, std)])
    data = VectorAssembler(inputCols=cols, outputCol="x").transform(scaled)
    pc = PCA(k=components or bottleneck(len(cols)), inputCol="x", outputCol="z").fit(data).pc.toArray()
    return Fitted(list(cols), mean, std, pc.T.tolist())


def score(df: DataFrame, model: Fitted) -> DataFrame:
    """Adds ``anomaly_score``, the distance between a row and its reconstruction.

    With orthonormal axes the squared distance is |x|^2 - |z|^2: one expression, no Python.
    """
    x = [(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - m) / s for c, m, s in zip(model.cols, model.mean, model.std)]
    named = df.withColumn("_x", F.array(*x))
    size = F.aggregate("_x", F.lit(0.0), lambda a, v: a + v * v)
    kept = [
        reduce(lambda a, b: a + b, [F.col("_x")[i] * v for i, v in enumerate(axis)]) for axis in model.axes
    ]
    explained = reduce(lambda a, b: a + b, [z * z for z in kept])
    return named.withColumn("anomaly_score", F.sqrt(F.greatest(size - explained, F.lit(0.0)))).drop("_x")
