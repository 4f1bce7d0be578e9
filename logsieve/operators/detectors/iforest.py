"""Isolation forest (Liu, Ting and Zhou, 2008).

Each tree is grown in one task from its own sample of 256 rows (the definition of the method), drawn from all rows
by a hash of the row key.
The forest (100 trees of at most 511 nodes) is small by construction and goes to the tasks that score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

EULER = 0.5772156649015329


@dataclass
class Fitted:
    """Node arrays, one row per tree: split feature (-1 for a leaf), threshold, left child, path length."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    sample: int
    cols: list[str]


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    full = 2 * (np.log(safe - 1) + EULER) - 2 * (safe - 1) / safe
    return np.where(n > 2, full, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple[int, float, int, float]]:
    nodes: list[tuple[int, float, int, float]] = [(-1, 0.0, -1, 0.0)]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        part = x[rows]
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) > 1 else []
        if depth >= limit or len(spread) == 0:
            nodes[at] = (-1, 0.0, -1, depth + float(average_path(len(rows))))
            continue
        f = int(rng.choice(spread))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        go_left = part[:, f] <= cut
        left = len(nodes)
        nodes[at] = (f, cut, left, 0.0)
        nodes += [(-1, 0.0, -1, 0.0)] * 2
        todo += [(left, rows[go_left], depth + 1), (left + 1, rows[~go_left], depth + 1)]
    return nodes


def fit(df: DataFrame, cols: list[str], key: str, trees: int = 100, sample: int = 256, seed: int = 42) -> Fitted:
    """Grow the forest; ``key`` is unique and decides, with the seed, which rows a tree sees."""
    data = df.select(F.col(key).cast("string").alias("_key"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    # Every tree draws from all rows: those with the least hashes for this tree.  A bound on the hash, four times as
    # wide as needed on average, leaves about 4 * sample rows per tree to rank, whatever the size of the table.
    n = data.count()
    bound = (1 << 63) - 1 if n <= 4 * sample else int(-(1 << 63) + (1 << 64) * (4 * sample / n))
    lots = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64("_key", t, F.lit(seed)).alias("lot")))
    drawn = data.withColumn("_lot", F.explode(F.filter(lots, lambda x: x["lot"] <= F.lit(bound)))).select(
        "_key", *cols, F.col("_lot.tree").alias("tree"), F.col("_lot.lot").alias("lot"))
    order = W.partitionBy("tree").orderBy("lot", "_key")
    drawn = drawn.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= sample)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("_rn")
        x = pdf[cols].to_numpy(dtype=float)
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        nodes = _grow(x, np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "depth"])
        return out.assign(tree=tree, node=np.arange(len(out)), size=len(x))

    schema = "feature int, threshold double, left int, depth double, tree int, node int, size int"
    nodes = drawn.groupBy("tree").applyInPandas(grow, schema).toPandas()
    if nodes.empty:
        raise ValueError("no rows to fit")
    width = int(nodes["node"].max()) + 1
    shape = (trees, width)
    arrays = {
        "feature": np.full(shape, -1, dtype=np.int32), "threshold": np.zeros(shape),
        "left": np.zeros(shape, dtype=np.int32), "depth": np.zeros(shape),
    }
    at = (nodes["tree"].to_numpy(), nodes["node"].to_numpy())
    for name, values in arrays.items():
        values[at] = nodes[name].to_numpy()
    return Fitted(**arrays, sample=int(nodes["size"].max()), cols=list(cols))


def path_lengths(x: np.ndarray, model: Fitted) -> np.ndarray:
    """Mean path length of each row over the trees; all rows step down a tree together."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, threshold, left, depth in zip(model.feature, model.threshold, model.left, model.depth):
        at = np.zeros(len(x), dtype=np.int32)
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            right = x[rows, np.maximum(f, 0)] > threshold[at]
            at = np.where(inner, left[at] + right, at)
        total += depth[at]
    return total / len(model.feature)


def score(df: DataFrame, model: Fitted) -> DataFrame:
    """Adds ``anomaly_score`` in 0..1."""
    norm = float(average_path(model.sample)) or 1.0
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def forest_score(*parts: pd.Series) -> pd.Series:
        x = np.column_stack([p.to_numpy(dtype=float) for p in parts])
        return pd.Series(np.power(2.0, -path_lengths(x, shared.value) / norm))

    inputs = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in model.cols]
    return df.withColumn("anomaly_score", forest_score(*inputs))
