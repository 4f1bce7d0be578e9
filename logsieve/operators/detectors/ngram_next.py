"""Probability of the next template given the ones before it.

Stands for a recurrent next-template model: counts of (context, next) with additive smoothing, backing
off to shorter contexts when a context was never seen.  Same inputs, outputs and threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ...scratch import materialize
from ..ordering import row_count
from ..sequences import BUCKET_ROWS, over_sequences
from ..vocabulary import template_vocab, with_template_id

UNKNOWN = -1


@dataclass
class Fitted:
    """``vocab``: templates; ``pairs``: (size, context, next_id, n); ``contexts``: (size, context, total, top_id)."""

    vocab: DataFrame
    pairs: DataFrame
    contexts: DataFrame
    w: int
    order: int
    alpha: float


def _targets(ids: DataFrame, w: int, order: int, bucket_rows: int) -> DataFrame:
    """Start index, the last ``order`` ids before the target, and the target id ``w`` rows after the start."""
    near = over_sequences(ids, order + 1, {"_ids": F.collect_list("template_id")}, bucket_rows=bucket_rows)
    lag = w - order
    return near.filter(F.col("sequence_index") >= lag).select(
        (F.col("sequence_index") - lag).alias("sequence_index"),
        F.slice("_ids", 1, order).alias("_ctx"),
        F.element_at("_ids", order + 1).alias("actual_template"),
    )


def _contexts(targets: DataFrame, order: int) -> DataFrame:
    """One row per context size from ``order`` down to 0."""
    sizes = F.explode(F.sequence(F.lit(0), F.lit(order))).alias("size")
    return targets.select("*", sizes).withColumn(
        "context", F.concat_ws(",", F.slice("_ctx", order + 1 - F.col("size"), F.col("size")))
    )


def fit(
    logs: DataFrame, w: int = 15, order: int = 2, alpha: float = 1.0, vocab: DataFrame | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> Fitted:
    """``logs``: indexed rows with ``template``.  ``order`` is the longest context, ``w`` the look-back."""
    if not 0 < order <= w:
        raise ValueError("order must lie between 1 and the sequence length")
    vocab = template_vocab(logs) if vocab is None else vocab
    ids = with_template_id(logs, vocab, UNKNOWN).select("idx", "template_id")
    seen = _contexts(_targets(ids, w, order, bucket_rows), order)
    counted = seen.groupBy("size", "context", F.col("actual_template").alias("next_id")).agg(F.count("*").alias("n"))
    pairs = materialize(counted, "pairs")
    contexts = pairs.groupBy("size", "context").agg(
        F.sum("n").alias("total"),
        F.min(F.struct((-F.col("n")).alias("n"), "next_id"))["next_id"].alias("top_id"),
    )
    return Fitted(vocab, pairs, contexts, w, order, alpha)


def score(logs: DataFrame, fitted: Fitted, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``1 - P(actual next)`` for every sequence with a follower.

    Equal (context, next) cases are scored once and joined back, so frequent cases cost no more in the
    lookup than rare ones.  A template that was never seen gets the smoothing mass only.
    """
    ids = with_template_id(logs, fitted.vocab, UNKNOWN).select("idx", "template_id")
    targets = _targets(ids, fitted.w, fitted.order, bucket_rows)
    cases = targets.groupBy("_ctx", "actual_template").agg(F.count("*").alias("_n")).drop("_n")
    known = _contexts(cases, fitted.order).join(fitted.contexts, ["size", "context"])
    longest = known.groupBy("_ctx", "actual_template").agg(
        F.max(F.struct("size", "context", "total", "top_id")).alias("_b")
    ).select("_ctx", "actual_template", "_b.*")
    size = row_count(fitted.vocab) + 1  # one more for everything unseen
    scored = (
        longest.join(
            fitted.pairs.withColumnRenamed("next_id", "actual_template"),
            ["size", "context", "actual_template"], "left",
        )
        .withColumn("prediction_prob", (F.coalesce("n", F.lit(0)) + fitted.alpha) / (F.col("total") + fitted.alpha * size))
        .select("_ctx", "actual_template", F.col("top_id").alias("predicted_template"), "prediction_prob")
    )
    return (
        targets.join(scored, ["_ctx", "actual_template"])
        .select(
            "sequence_index", "predicted_template", "actual_template", "prediction_prob",
            (1 - F.col("prediction_prob")).alias("anomaly_score"),
        )
    )


def detect(logs: DataFrame, fitted: Fitted, threshold: float = 0.5, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    return score(logs, fitted, bucket_rows).filter(F.col("anomaly_score") > threshold).withColumn(
        "is_anomaly", F.lit(True)
    )


def mark_target(scored: DataFrame, w: int) -> DataFrame:
    """Scores keyed by the row they are about, for spreading over one row instead of the sequence."""
    return scored.withColumn("sequence_index", F.col("sequence_index") + w)
