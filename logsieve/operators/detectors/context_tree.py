"""Probability of the next template from contexts of any length up to the whole look-back.

A tree of contexts, the shortest first: a node is the run of the last k templates, seen ``least`` times or more.  It is
grown a few levels at a time, and deeper only for the cases whose longest context so far is a node, so the rows thin
out as contexts grow rare, and growth ends where no node is left.  The probabilities of all
nodes on the path of a case are blended by escapes: with N cases, T different followers and n for the template asked,
p(k) = (n + T p(k-1)) / (N + T), and p(-1) is even over the vocabulary and one more for everything unseen.

Cases that are equal in all of the look-back and the target are counted once, with their number, both here and when
scoring.  Everything stays in tables; only the counts of the root (one row) come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ...scratch import materialize
from ..sequences import BUCKET_ROWS, next_event_pairs
from ..vocabulary import template_vocab, with_template_id
from .ngram_next import UNKNOWN

LEVELS = 4  # counted together: fewer passes, and only so many rows a case

@dataclass
class Fitted:
    """``pairs``: (size, context, next_id, n); ``nodes``: (size, context, total, kinds, top_id); ``depth``: longest context."""

    vocab: DataFrame
    pairs: DataFrame
    nodes: DataFrame
    w: int
    depth: int


def _tail(size: int | Column) -> Column:
    """The last ``size`` ids of a case, as text."""
    return F.concat_ws(",", F.reverse(F.slice(F.reverse("sequence"), F.lit(1), F.lit(size) if isinstance(size, int) else size)))


def fit(
    logs: DataFrame, w: int = 15, order: int | None = None, least: int = 2, vocab: DataFrame | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> Fitted:
    """``logs``: indexed rows with ``template``.  ``order`` is the longest context (all of the look-back by default)."""
    order = w if order is None else order
    if not 0 < order <= w:
        raise ValueError("order must lie between 1 and the sequence length")
    vocab = template_vocab(logs) if vocab is None else vocab
    ids = with_template_id(logs, vocab, UNKNOWN).select("idx", "template_id")
    seen = next_event_pairs(ids, w, bucket_rows=bucket_rows).withColumnRenamed("next_value", "next_id")
    cases = materialize(seen.groupBy("sequence", "next_id").agg(F.count("*").alias("n")), "cases")
    return grow(cases, vocab, w, order, least)


def grow(cases: DataFrame, vocab: DataFrame, w: int, order: int, least: int) -> Fitted:
    """The tree from counted cases (sequence, next_id, n); ``LEVELS`` levels are counted in one pass."""
    counted, active = [], cases
    for low in range(0, order + 1, LEVELS):
        high = min(low + LEVELS - 1, order)
        sizes = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("size")
        keyed = active.select("*", sizes).withColumn("context", _tail(F.col("size")))
        counted.append(materialize(keyed.groupBy("size", "context", "next_id").agg(F.sum("n").alias("n")), "counted"))
        if high < order:
            kept = _nodes(counted[-1].filter(F.col("size") == high), least).select("context")
            active = materialize(active.withColumn("context", _tail(high)).join(kept, "context", "leftsemi").drop("context"), "active")
            if active.isEmpty():
                break
    pairs = reduce(DataFrame.unionByName, counted)
    nodes = materialize(_nodes(pairs, least), "tree_nodes")
    depth = nodes.agg(F.max("size")).first()[0] or 0
    kept = pairs.join(nodes.select("size", "context"), ["size", "context"], "leftsemi")
    return Fitted(vocab, materialize(kept, "tree_pairs"), nodes, w, depth)


def _nodes(pairs: DataFrame, least: int) -> DataFrame:
    """Contexts seen often enough; the root always is."""
    return pairs.groupBy("size", "context").agg(
        F.sum("n").alias("total"), F.count("*").alias("kinds"),
        F.min(F.struct((-F.col("n")).alias("n"), "next_id"))["next_id"].alias("top_id"),
    ).filter((F.col("size") == 0) | (F.col("total") >= least))


def score_cases(cases: DataFrame, fitted: Fitted) -> DataFrame:
    """``predicted_template`` and ``prediction_prob`` of distinct cases (sequence, next_id); the last ids count.

    A step of the path is the map p -> a + b p; the steps of a case are gathered (one more than ``depth`` at most) and
    applied in order.
    """
    root = fitted.nodes.filter("size = 0").select("total", "kinds", "top_id").first()
    total, kinds, top = (root.total, root.kinds, root.top_id) if root else (0, 0, None)
    even = 1.0 / (fitted.vocab.count() + 1)
    first = fitted.pairs.filter("size = 0").select("next_id", F.col("n").alias("_n0"))
    start = (F.coalesce("_n0", F.lit(0)) + kinds * even) / (total + kinds) if total else F.lit(even)
    asked = cases.select("sequence", "next_id").join(first, "next_id", "left").withColumn("_p0", start).drop("_n0")
    sizes = F.sequence(F.lit(1), F.lit(fitted.depth)) if fitted.depth else F.array().cast("array<int>")
    steps = asked.select("*", F.explode(sizes).alias("size")).withColumn("context", _tail(F.col("size")))
    found = steps.join(fitted.nodes.filter("size > 0"), ["size", "context"]).join(
        fitted.pairs.filter("size > 0"), ["size", "context", "next_id"], "left"
    )
    whole = F.col("total") + F.col("kinds")
    paths = found.groupBy("sequence", "next_id").agg(
        F.array_sort(F.collect_list(F.struct("size", (F.coalesce("n", F.lit(0)) / whole).alias("a"), (F.col("kinds") / whole).alias("b"), "top_id"))).alias("_path")
    )
    path = F.coalesce("_path", F.array().cast("array<struct<size:int,a:double,b:double,top_id:bigint>>"))
    return asked.join(paths, ["sequence", "next_id"], "left").select(
        "sequence", "next_id",
        F.coalesce(F.try_element_at("_path", F.lit(-1))["top_id"], F.lit(top).cast("long")).alias("predicted_template"),
        F.aggregate(path, F.col("_p0"), lambda p, s: s["a"] + s["b"] * p).alias("prediction_prob"),
    )


def score(logs: DataFrame, fitted: Fitted, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``1 - P(actual next)`` for every sequence with a follower."""
    ids = with_template_id(logs, fitted.vocab, UNKNOWN).select("idx", "template_id")
    return score_targets(next_event_pairs(ids, fitted.w, bucket_rows=bucket_rows).withColumnRenamed("next_value", "next_id"), fitted).select(
        "sequence_index", "predicted_template", "actual_template", "prediction_prob", "anomaly_score"
    )


def score_targets(targets: DataFrame, fitted: Fitted) -> DataFrame:
    """The rows of ``targets`` (sequence, next_id and others) with the scores of their cases."""
    scored = score_cases(targets.select("sequence", "next_id").distinct(), fitted)
    return (
        targets.join(scored, ["sequence", "next_id"])
        .withColumnRenamed("next_id", "actual_template")
        .withColumn("anomaly_score", 1 - F.col("prediction_prob"))
        .drop("sequence")
    )


def detect(logs: DataFrame, fitted: Fitted, threshold: float = 0.5, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    return score(logs, fitted, bucket_rows).filter(F.col("anomaly_score") > threshold).withColumn(
        "is_anomaly", F.lit(True)
    )
