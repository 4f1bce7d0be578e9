"""Sequences whose mean template vector is far from the normal mean.

Fit needs no sequences: in N rows, row i lies in min(i+1, w, N-i, N-w+1) of the sliding sequences, so
mean and deviation over all cells of all sequences are weighted sums over the rows, and these are sums
over templates.  Scoring adds up ``w`` shifted copies of the rows of a bucket in one numpy step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ...scratch import materialize
from ..ordering import row_count
from ..sequences import BUCKET, BUCKET_ROWS, with_forward_halo
from ..vocabulary import tfidf_entries

STD_FLOOR = 1e-8


@dataclass
class Fitted:
    """``vectors``: (template, dims, vals); ``moments``: (dim, mean, std); ``w``: sequence length."""

    vectors: DataFrame
    moments: DataFrame
    w: int


def sequence_moments(indexed: DataFrame, entries: DataFrame, w: int) -> DataFrame:
    """Mean and population deviation of each dimension over all cells of all sequences."""
    return _moments(template_cells(indexed, w), entries, (row_count(indexed) - w + 1) * w)


def template_cells(indexed: DataFrame, w: int) -> DataFrame:
    """(template, cells): how many cells of all sequences hold the template."""
    n = row_count(indexed)
    i = F.col("idx")
    covers = F.least(i + 1, F.lit(w), n - i, n - w + 1)
    return indexed.groupBy("template").agg(F.sum(covers).alias("cells"))


def _moments(per_template: DataFrame, entries: DataFrame, cells: Column) -> DataFrame:
    weighted = entries.join(per_template, "template").groupBy("dim", "term").agg(
        F.sum(F.col("value") * F.col("cells")).alias("_s1"),
        F.sum(F.col("value") * F.col("value") * F.col("cells")).alias("_s2"),
    )
    mean = F.col("_s1") / cells
    return weighted.select(
        "dim", "term", mean.alias("mean"),
        (F.sqrt(F.greatest(F.col("_s2") / cells - mean * mean, F.lit(0.0))) + STD_FLOOR).alias("std"),
    )


def fit(indexed: DataFrame, w: int = 15, max_terms: int = 100) -> Fitted:
    """``indexed``: normal rows with ``idx`` (dense, from 0) and ``template``."""
    # one pass over the rows; everything else works on templates
    per_template = materialize(template_cells(indexed, w), "templates")
    entries = materialize(tfidf_entries(per_template, max_terms), "entries")
    vectors = entries.groupBy("template").agg(
        F.collect_list("dim").alias("dims"), F.collect_list("value").alias("vals")
    )
    return Fitted(vectors, _moments(per_template, entries, (row_count(indexed) - w + 1) * w), w)


def _moment_arrays(fitted: Fitted) -> tuple[np.ndarray, np.ndarray]:
    # one row per dimension (100 at most)
    table = fitted.moments.orderBy("dim").select("mean", "std").collect()
    if not table:
        raise ValueError("the fitted rows hold no terms")
    return np.array([r[0] for r in table]), np.array([r[1] for r in table])


def score(indexed: DataFrame, fitted: Fitted, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``max_z_score`` of every sequence of ``w`` rows."""
    w = fitted.w
    mean, std = _moment_arrays(fitted)
    n = row_count(indexed)
    rows = indexed.select("idx", "template").join(fitted.vectors, "template", "left").select("idx", "dims", "vals")
    halo = with_forward_halo(rows, w, bucket_rows=bucket_rows).select(BUCKET, "idx", "dims", "vals")
    size = max(bucket_rows, w)

    def bucket_scores(batch: pa.Table) -> pa.Table:
        batch = batch.combine_chunks().sort_by("idx")
        idx = batch["idx"].to_numpy()
        dims, vals = (batch[c].combine_chunks() for c in ("dims", "vals"))
        lengths = dims.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        dense = np.zeros((len(idx), len(mean)))
        dense[np.repeat(np.arange(len(idx)), lengths), dims.flatten().to_numpy()] = vals.flatten().to_numpy()
        starts = len(idx) - w + 1
        if starts <= 0:
            return pa.table({"sequence_index": pa.array([], pa.int64()), "max_z_score": pa.array([], pa.float64())})
        total = dense[:starts].copy()
        for k in range(1, w):
            total += dense[k:k + starts]
        worst = np.abs((total / w - mean) / std).max(axis=1)
        own = idx[:starts] // size == batch[BUCKET][0].as_py()
        return pa.table({"sequence_index": idx[:starts][own], "max_z_score": worst[own]})

    scored = halo.groupBy(BUCKET).applyInArrow(bucket_scores, "sequence_index long, max_z_score double")
    return scored.filter(F.col("sequence_index") <= n - w)


def score_id_sequences(cases: DataFrame, fitted: Fitted, vocab: DataFrame) -> DataFrame:
    """``max_z_score`` of distinct ``sequence`` arrays of template ids, for lines that carry no row number.

    ``vocab`` gives the ids; an id outside it, or a template without a kept term, counts as a zero vector.
    """
    w = fitted.w
    mean, std = _moment_arrays(fitted)
    vectors = fitted.vectors.join(vocab.select("template", "template_id"), "template").select("template_id", "dims", "vals")
    lines = cases.select("sequence", F.explode("sequence").alias("template_id")).join(vectors, "template_id", "left")
    packed = lines.groupBy("sequence").agg(
        F.flatten(F.collect_list("dims")).alias("dims"), F.flatten(F.collect_list("vals")).alias("vals")
    )

    def worst(batches):
        for batch in batches:
            dims, vals = batch.column("dims"), batch.column("vals")
            total = np.zeros((batch.num_rows, len(mean)))
            rows = np.repeat(np.arange(batch.num_rows), dims.value_lengths().to_numpy(zero_copy_only=False))
            np.add.at(total, (rows, dims.flatten().to_numpy()), vals.flatten().to_numpy())
            scores = np.abs((total / w - mean) / std).max(axis=1, initial=0.0)
            yield pa.RecordBatch.from_arrays([batch.column("sequence"), pa.array(scores)], ["sequence", "max_z_score"])

    return packed.mapInArrow(worst, "sequence array<long>, max_z_score double")


def detect(indexed: DataFrame, fitted: Fitted, threshold: float = 3.0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Sequences beyond the threshold; the score is in multiples of it."""
    return with_anomaly_score(score(indexed, fitted, bucket_rows), threshold).filter("is_anomaly")


def with_anomaly_score(scored: DataFrame, threshold: float = 3.0) -> DataFrame:
    return scored.withColumns({
        "anomaly_score": F.col("max_z_score") / threshold,
        "is_anomaly": F.col("max_z_score") > threshold,
    })
