"""One-class SVM with an RBF kernel by random Fourier features (Rahimi and Recht, 2007).

The linear one-class objective is minimised by full-batch subgradient steps.  A step is one pass over
the rows: each task sends the sums of its rows, a few hundred numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..baseline import fit_scaler


@dataclass
class Fitted:
    cols: list[str]
    mean: np.ndarray
    std: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    offset: float


def _lift(x: np.ndarray, freq: np.ndarray, phase: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 / len(phase)) * np.cos(x @ freq + phase)


def _inputs(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])


def fit(df: DataFrame, cols: list[str], nu: float = 0.5, features: int = 128, steps: int = 25, seed: int = 42) -> Fitted:
    data = _inputs(df, cols)
    row = fit_scaler(data, cols).first()
    n = data.count()
    if n == 0:
        raise ValueError("no rows to fit")
    mean = np.array([row[f"{c}_mean"] for c in cols])
    std = np.array([row[f"{c}_std"] for c in cols])
    rng = np.random.default_rng(seed)
    freq = rng.normal(0.0, np.sqrt(2.0 / len(cols)), (len(cols), features))  # kernel width 1 / inputs
    phase = rng.uniform(0.0, 2 * np.pi, features)
    weights, offset = np.zeros(features), 0.0

    def sums(w: np.ndarray, rho: float):
        def task(batches):
            total = np.zeros(features + 1)
            for pdf in batches:
                z = _lift((pdf.to_numpy(dtype=float) - mean) / std, freq, phase)
                inside = z @ w <= rho
                total[:features] += z[inside].sum(axis=0)
                total[features] += inside.sum()
            yield pd.DataFrame({"at": np.arange(features + 1), "part": total})
        return task

    for t in range(1, steps + 1):
        parts = data.mapInPandas(sums(weights, offset), "at int, part double")
        # one number per feature comes back
        got = parts.groupBy("at").agg(F.sum("part").alias("total")).toPandas()
        total = np.zeros(features + 1)
        total[got["at"].to_numpy()] = got["total"].to_numpy()
        rate = 1.0 / t
        pull, share = total[:features] / (nu * n), total[features] / (nu * n)
        weights = weights - rate * (weights - pull)
        offset = offset - 0.5 * rate * (share - 1.0)
    return Fitted(list(cols), mean, std, freq, phase, weights, float(offset))


def score(df: DataFrame, model: Fitted) -> DataFrame:
    """Adds ``anomaly_score``: how far a row lies on the outer side of the boundary."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def outside(*parts: pd.Series) -> pd.Series:
        m = shared.value
        x = (np.column_stack([p.to_numpy(dtype=float) for p in parts]) - m.mean) / m.std
        return pd.Series(m.offset - _lift(x, m.freq, m.phase) @ m.weights)

    inputs = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in model.cols]
    return df.withColumn("anomaly_score", outside(*inputs))
