"""Template vectors from what follows what: a randomised SVD of the sharded co-occurrence matrix.

Entry (a, b) is the positive pointwise mutual information of b coming within ``reach`` lines after a.  The matrix stays
a table of its non-zero entries.  Products with a thin matrix are joins and sums; orthogonalising needs only the small
matrix of inner products of the thin columns, summed by Spark, so the driver holds some 20 x 20 numbers whatever the
size of the vocabulary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..scratch import materialize
from .sequences import BUCKET_ROWS, over_sequences

TINY = 1e-10  # columns below this share of the largest one are noise


def follow_counts(indexed: DataFrame, reach: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b, n): how often template b came 1 to ``reach`` lines after template a."""
    ends = over_sequences(indexed.select("idx", "template"), reach + 1, {"_t": F.collect_list("template")}, bucket_rows=bucket_rows)
    after = F.explode(F.slice("_t", 2, reach)).alias("b")
    return ends.select(F.element_at("_t", 1).alias("a"), after).groupBy("a", "b").agg(F.count("*").alias("n"))


def mutual_information(counts: DataFrame) -> DataFrame:
    """(a, b, v) with v > 0."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows, cols = counts.groupBy("a").agg(F.sum("n").alias("_na")), counts.groupBy("b").agg(F.sum("n").alias("_nb"))
    value = F.log(F.col("n") * F.lit(float(total)) / (F.col("_na") * F.col("_nb")))
    return counts.join(rows, "a").join(cols, "b").select("a", "b", value.alias("v")).filter("v > 0")


def _times(matrix: DataFrame, side: str, thin: DataFrame, width: int) -> DataFrame:
    """(template, y): the matrix, or its transpose for ``side`` b, times (template, y)."""
    other = "b" if side == "a" else "a"
    joined = matrix.join(thin.withColumnRenamed("template", other), other)
    sums = [F.sum(F.col("v") * F.element_at("y", k + 1)).alias(f"_{k}") for k in range(width)]
    summed = joined.groupBy(F.col(side).alias("template")).agg(*sums)
    return materialize(summed.select("template", F.array(*[f"_{k}" for k in range(width)]).alias("y")), "thin")


def _gram(thin: DataFrame, width: int) -> np.ndarray:
    """Inner products of the columns of a thin matrix: each task sends the sums over its rows."""

    def products(batches):
        total = np.zeros((width, width))
        for batch in batches:
            y = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, width)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["at", "part"])

    out = np.zeros(width * width)
    for r in thin.select("y").mapInArrow(products, "at long, part double").groupBy("at").agg(F.sum("part").alias("part")).collect():
        out[r["at"]] = r["part"]
    return out.reshape(width, width)


def _turn(thin: DataFrame, by: np.ndarray) -> DataFrame:
    """The rows of a thin matrix times a small one."""

    def turn(batches):
        for batch in batches:
            y = batch.column("y").flatten().to_numpy().reshape(batch.num_rows, -1) @ by
            flat = pa.array(np.ascontiguousarray(y).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("template"), pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * by.shape[1]), flat)], ["template", "y"])

    return thin.mapInArrow(turn, "template string, y array<double>")


def _basis(gram: np.ndarray) -> np.ndarray:
    """What turns columns with these inner products into orthonormal ones; noise is left out."""
    values, vectors = np.linalg.eigh(gram)
    keep = values > TINY * max(values.max(), 0.0)
    return vectors[:, keep] / np.sqrt(values[keep]) if keep.any() else np.zeros((len(gram), 0))


def template_embedding(indexed: DataFrame, dims: int = 16, reach: int = 3, spare: int = 4, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, int]:
    """(template, before, after) and the number of dimensions (``dims`` at most).

    ``before`` is the template's place among what others follow, ``after`` among what follows others: their product
    over a pair of neighbours is high for the usual order and low for the reverse.
    """
    matrix = materialize(mutual_information(materialize(follow_counts(indexed, reach, bucket_rows), "follows")), "information")
    width = dims + spare
    signs = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda k: F.when(F.xxhash64("template", k) % 2 == 0, 1.0).otherwise(-1.0))
    thin = matrix.select(F.col("b").alias("template")).distinct().select("template", signs.alias("y"))
    for side in ("a", "b", "a"):  # one power step between two projections
        thin = _times(matrix, side, thin, width)
        basis = _basis(_gram(thin, width))
        width = basis.shape[1]
        thin = _turn(thin, basis)
        if not width:
            break
    left = materialize(thin, "left")
    right = _times(matrix, "b", left, width) if width else left
    values, turn = np.linalg.eigh(_gram(right, width)) if width else (np.zeros(0), np.zeros((0, 0)))
    best = [k for k in np.argsort(-values)[:dims] if values[k] > TINY * values.max()]
    root = values[best] ** 0.25  # square root of the singular value
    before = _turn(left, turn[:, best] * root).withColumnRenamed("y", "before")
    after = _turn(right, turn[:, best] / root).withColumnRenamed("y", "after")  # its columns already have that length
    return materialize(before.join(after, "template", "full"), "embedding"), len(best)
