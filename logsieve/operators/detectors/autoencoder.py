"""Reconstruction error of a neural auto-encoder: tanh layers around a bottleneck, trained where the rows are.

A round sends the weights to all tasks; each goes over its rows in mini-batches and improves its copy of the weights
(Adam), and the copies are averaged by rows.  Layer sizes follow the number of inputs, rounds and mini-batches the
number of rows.  A task holds its weights and one Arrow batch; Spark adds up as many numbers as there are weights, and
only these come to the driver.  Fewer than 10 rows are refused.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ...scratch import materialize
from ..baseline import fit_scaler
from .pca_recon import MIN_ROWS, bottleneck


@dataclass
class Fitted:
    cols: list[str]
    mean: list[float]
    std: list[float]
    sizes: list[int]  # inputs, hidden layers, outputs
    weights: list[float]  # all layers, each its matrix and its shift


def hidden_layers(features: int) -> list[int]:
    """Widths of the layers between input and output; the middle one is the bottleneck."""
    middle = bottleneck(features)
    if features <= 5:
        return [max(4, features), middle, max(4, features)]
    return [16, middle, 16] if features <= 10 else [64, 32, middle, 32, 64]


def schedule(rows: int) -> tuple[int, int, int]:
    """(rounds, rows of a mini-batch, passes over a batch in a round) for a number of rows: few rows are used more often."""
    passes = max(1, min(10, 20_000 // max(rows, 1)))
    if rows < 50:
        return 20, min(8, rows), passes
    return (30, 16, passes) if rows < 100 else (50, 32, passes)


def layers(weights: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + (a + 1) * b]))
        at += (a + 1) * b
    return out


def first_weights(sizes: list[int], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in zip(sizes, sizes[1:]):
        parts += [rng.normal(0.0, np.sqrt(2.0 / (a + b)), a * b), np.zeros(b)]
    return np.concatenate(parts)


def forward(weights: np.ndarray, sizes: list[int], x: np.ndarray) -> list[np.ndarray]:
    """Values of all layers, the input first; the last one is linear."""
    values = [x]
    steps = layers(weights, sizes)
    for k, (matrix, shift) in enumerate(steps):
        z = values[-1] @ matrix + shift
        values.append(z if k == len(steps) - 1 else np.tanh(z))
    return values


def loss_and_gradient(weights: np.ndarray, sizes: list[int], x: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean squared distance of rows and reconstructions (halved), and its gradient."""
    values = forward(weights, sizes, x)
    back = (values[-1] - x) / len(x)
    parts: list[np.ndarray] = []
    steps = layers(weights, sizes)
    for k in range(len(steps) - 1, -1, -1):
        parts = [(values[k].T @ back).ravel(), back.sum(axis=0), *parts]
        if k:
            back = (back @ steps[k][0].T) * (1 - values[k] ** 2)
    return 0.5 * float(((values[-1] - x) ** 2).sum()) / len(x), np.concatenate(parts)


class Adam:
    def __init__(self, size: int, rate: float):
        self.first, self.second, self.rate, self.steps = np.zeros(size), np.zeros(size), rate, 0

    def step(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.steps += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient**2
        first, second = self.first / (1 - 0.9**self.steps), self.second / (1 - 0.999**self.steps)
        return weights - self.rate * first / (np.sqrt(second) + 1e-8)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)])


def _improve(weights: np.ndarray, sizes: list[int], batch_rows: int, passes: int, rate: float, seed: int):
    """A task's round: (position, sum over rows) of its weights, and its number of rows at the end."""

    def task(batches):
        own, rows = weights, 0
        adam = Adam(len(weights), rate)
        rng = np.random.default_rng(seed)
        for batch in batches:
            x = _matrix(batch)
            for _ in range(passes):
                order = rng.permutation(len(x))
                for at in range(0, len(x), batch_rows):
                    own = adam.step(own, loss_and_gradient(own, sizes, x[order[at : at + batch_rows]])[1])
            rows += len(x)
        if rows:
            total = np.append(own * rows, rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "part"])

    return task


def fit(df: DataFrame, cols: list[str], hidden: list[int] | None = None, rounds: int | None = None, rate: float = 0.01, seed: int = 42) -> Fitted:
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    n = filled.count()
    if n < MIN_ROWS:
        raise ValueError(f"at least {MIN_ROWS} rows are needed")
    row = fit_scaler(filled, cols).first()
    mean, std = [row[f"{c}_mean"] for c in cols], [row[f"{c}_std"] for c in cols]
    # written once: every round reads the same splits
    data = materialize(filled.select(*[((F.col(c) - m) / s).alias(c) for c, m, s in zip(cols, mean, std)]), "scaled")
    sizes = [len(cols), *(hidden or hidden_layers(len(cols))), len(cols)]
    planned, batch_rows, passes = schedule(n)
    weights = first_weights(sizes, seed)
    for turn in range(rounds or planned):
        # smaller steps towards the end
        parts = data.mapInArrow(_improve(weights, sizes, batch_rows, passes, rate / (1 + 0.1 * turn), seed + turn), "at long, part double")
        total = np.zeros(len(weights) + 1)
        for r in parts.groupBy("at").agg(F.sum("part").alias("part")).collect():
            total[r["at"]] = r["part"]
        weights = total[:-1] / total[-1]
    return Fitted(list(cols), mean, std, sizes, weights.tolist())


def score(df: DataFrame, model: Fitted) -> DataFrame:
    """Adds ``anomaly_score``, the distance between a row and its reconstruction."""
    weights, sizes = np.array(model.weights), model.sizes

    def distance(x: pa.Array) -> pa.Array:
        rows = x.flatten().to_numpy().reshape(-1, sizes[0])
        return pa.array(np.sqrt(((forward(weights, sizes, rows)[-1] - rows) ** 2).sum(axis=1)))

    distance.__annotations__ = {"x": pa.Array, "return": pa.Array}
    x = [(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - m) / s for c, m, s in zip(model.cols, model.mean, model.std)]
    return df.withColumn("anomaly_score", F.arrow_udf(distance, "double")(F.array(*x)))
