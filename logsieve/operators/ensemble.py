"""Ensembles of several detectors that scored the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import materialize
from .evaluate import classification_metrics, roc_auc

EPS = 1e-8


def _add(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def majority(preds: list[str]) -> Column:
    """1 if at least half of the votes say so: a tie is an anomaly."""
    return (_add([F.col(p) for p in preds]) >= len(preds) / 2).cast("int")


def any_vote(preds: list[str]) -> Column:
    return F.greatest(*preds) if len(preds) > 1 else F.col(preds[0])


def all_votes(preds: list[str]) -> Column:
    return F.least(*preds) if len(preds) > 1 else F.col(preds[0])


def min_max(df: DataFrame, scores: list[str], prefix: str = "n_") -> DataFrame:
    """Scores scaled to 0..1; a score with negative values is turned around first."""
    # one row of ends, read once: they become constants of the plan
    ends = df.agg(*[f(c).cast("double").alias(f"{c}_{k}") for c in scores for k, f in (("lo", F.min), ("hi", F.max))]).first()

    def scaled(c: str) -> Column:
        lo, hi = ends[f"{c}_lo"], ends[f"{c}_hi"]
        if lo is None:
            return F.lit(None).cast("double")
        width = F.lit(hi) - F.lit(lo) + F.lit(EPS)
        return (F.lit(hi) - F.col(c)) / width if lo < 0 else (F.col(c) - F.lit(lo)) / width

    return df.withColumns({f"{prefix}{c}": scaled(c) for c in scores})


def ensemble_score(
    df: DataFrame, scores: list[str], weights: dict[str, float] | DataFrame | None = None,
    out: str = "ensemble_score",
) -> DataFrame:
    """Weighted mean of the scaled scores, equal weights by default.

    ``weights`` is a dict or the (model, weight) table of ``f1_weights``.
    """
    scaled = min_max(df, scores)
    if isinstance(weights, DataFrame):
        table = weights.select(F.map_from_entries(F.collect_list(F.struct("model", "weight")))).scalar()
        scaled = scaled.withColumn("_w", table)
        share = {c: F.coalesce(F.col("_w")[c], F.lit(1.0)) for c in scores}
    else:
        share = {c: F.lit(float((weights or {}).get(c, 1.0))) for c in scores}
    total = _add(list(share.values()))
    mean = _add([F.col(f"n_{c}") * share[c] / total for c in scores])
    return scaled.withColumn(out, mean).drop("_w", *[f"n_{c}" for c in scores])


def weighted_vote(df: DataFrame, scores: list[str], weights=None, out: str = "ensemble_pred") -> DataFrame:
    """1 where the weighted mean of the scaled scores passes one half."""
    voted = ensemble_score(df, scores, weights, "_mean")
    return voted.withColumn(out, (F.col("_mean") > 0.5).cast("int")).drop("_mean")


def ensemble(
    df: DataFrame, score_cols: list[str], pred_cols: list[str], method: str = "majority", weights=None
) -> DataFrame:
    """Adds ``ensemble_pred`` and ``ensemble_score``."""
    scored = ensemble_score(df, score_cols, weights if method == "weighted" else None)
    if method == "weighted":
        return scored.withColumn("ensemble_pred", (F.col("ensemble_score") > 0.5).cast("int"))
    votes = {"majority": majority, "max": any_vote, "min": all_votes}
    if method not in votes:
        raise ValueError(f"unknown method {method!r}; for 'stacking' use fit_stack and stack_predict")
    return scored.withColumn("ensemble_pred", votes[method](pred_cols))


def long_predictions(df: DataFrame, models: dict[str, tuple[str, str]], y: str = "y") -> DataFrame:
    """(model, y_true, y_pred, anomaly_score) rows from ``{model: (score column, prediction column)}``."""
    return df.select(F.inline(F.array(*[
        F.struct(
            F.lit(name).alias("model"),
            F.col(y).cast("int").alias("y_true"),
            F.col(pred).cast("int").alias("y_pred"),
            F.col(score).cast("double").alias("anomaly_score"),
        )
        for name, (score, pred) in models.items()
    ])))


def f1_weights(metrics: DataFrame) -> DataFrame:
    """F1 share of each model, equal shares if no model has any."""
    totals = metrics.select(F.struct(F.sum("f1").alias("s"), F.count("*").alias("n"))).scalar()
    return metrics.withColumn("_t", totals).select(
        "model", F.when(F.col("_t.s") > 0, F.col("f1") / F.col("_t.s")).otherwise(1.0 / F.col("_t.n")).alias("weight")
    )


def evaluate_models(df: DataFrame, models: dict[str, tuple[str, str]], y: str = "y") -> DataFrame:
    """Metrics and AUC, one row per model."""
    rows = long_predictions(df, models, y)
    return classification_metrics(rows, ["model"]).join(roc_auc(rows, ["model"]), "model", "left")


def compare_with_ensembles(
    df: DataFrame, models: dict[str, tuple[str, str]], y: str = "y", methods: tuple[str, ...] = ("majority", "weighted")
) -> DataFrame:
    """Metrics of the single models and of the ensembles; the weighted one uses F1 shares."""
    scores, preds = [s for s, _ in models.values()], [p for _, p in models.values()]
    df = materialize(df.select(y, *dict.fromkeys([*scores, *preds])), "scored")  # read by every step below
    by_score = F.create_map(*[F.lit(x) for name, (s, _) in models.items() for x in (name, s)])
    voted, entries = df, dict(models)
    for method in methods:
        weights = None
        if method == "weighted":
            plain = classification_metrics(long_predictions(df, models, y), ["model"])
            weights = f1_weights(plain).withColumn("model", by_score[F.col("model")])
        names = {f"ensemble_{part}": f"{method}_{part}" for part in ("score", "pred")}
        voted = ensemble(voted, scores, preds, method, weights).withColumnsRenamed(names)
        entries[f"ensemble_{method}"] = (f"{method}_score", f"{method}_pred")
    # single models and ensembles are evaluated together, in one pass each for cells and curves
    kind = F.when(F.col("model").isin(list(models)), "single").otherwise("ensemble")
    return evaluate_models(voted, entries, y).withColumn("kind", kind)


def fit_stack(df: DataFrame, scores: list[str], y: str = "y"):
    """Logistic regression over the scaled scores (a fitted ML model)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    scaled = min_max(df, scores)
    data = VectorAssembler(inputCols=[f"n_{c}" for c in scores], outputCol="features").transform(scaled)
    data = data.select("features", F.col(y).cast("double").alias("label"))
    # regParam 1 / rows stands for the unit L2 penalty per data set
    rows = max(data.count(), 1)
    return LogisticRegression(maxIter=1000, regParam=1.0 / rows, standardization=False).fit(data)


def stack_predict(df: DataFrame, scores: list[str], model) -> DataFrame:
    """Adds ``ensemble_score`` and ``ensemble_pred``; the scores are scaled as in the fit.

    The linear form is written out as an expression, so no ML transformer runs on the rows.
    """
    scaled = min_max(df, scores)
    linear = _add([F.col(f"n_{c}") * float(b) for c, b in zip(scores, model.coefficients)]) + float(model.intercept)
    return (
        scaled.withColumn("ensemble_score", 1 / (1 + F.exp(-linear)))
        .withColumn("ensemble_pred", (F.col("ensemble_score") > 0.5).cast("int"))
        .drop(*[f"n_{c}" for c in scores])
    )
