"""Evaluation against labels: confusion cells, curves, thresholds and model choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import materialize
from .ordering import lay_out, running_sums

# Quality targets and weights of the overall total.
TARGETS = {"accuracy": 0.70, "precision": 0.50, "recall": 0.60, "f1": 0.55, "specificity": 0.80}
TOTAL_WEIGHTS = {"f1": 0.4, "accuracy": 0.3, "recall": 0.2, "precision": 0.1}


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 on division by zero."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def with_metrics(cells: DataFrame) -> DataFrame:
    """Metrics from the columns tp, tn, fp, fn."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return cells.withColumns({
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "specificity": ratio(tn, tn + fp),
        "fpr": ratio(fp, fp + tn),
        "fnr": ratio(fn, fn + tp),
    })


def confusion(df: DataFrame, keys: list[str] = (), y: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """The four cells, counted one by one: they exist for one-class data too."""
    t, p = F.col(y) == 1, F.col(pred) == 1
    return df.groupBy(*keys).agg(
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & ~p).alias("tn"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
    )


def classification_metrics(df: DataFrame, keys: list[str] = (), y: str = "y_true", pred: str = "y_pred") -> DataFrame:
    return with_metrics(confusion(df, keys, y, pred))


def score_counts(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score: all curves start from this smaller table."""
    return df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")
    )


def curve_points(df: DataFrame, keys: list[str] = (), y: str = "y_true", score: str = "anomaly_score") -> DataFrame:
    """Cumulative true and false positives at each distinct score, from the highest score down."""
    return _curve(df, list(keys), y, score).drop("_t")


def _curve(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """Curve points with the class totals ``_t`` of their key (there are as many keys as models)."""
    laid = lay_out(score_counts(df, keys, y, score), [*keys, F.col("score").desc()], "scores")
    points = running_sums(laid, {"tp": "pos", "fp": "neg"}, keys).select(*keys, "score", "pos", "neg", "tp", "fp")
    both = F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    if not keys:
        return points.withColumn("_t", laid.select(both).scalar())
    return points.join(laid.groupBy(*keys).agg(both.alias("_t")), keys)


def roc_points(df: DataFrame, keys: list[str] = (), y: str = "y_true", score: str = "anomaly_score") -> DataFrame:
    """False and true positive rate at each distinct score."""
    keys = list(keys)
    return _curve(df, keys, y, score).select(
        *keys, F.col("score").alias("threshold"),
        ratio(F.col("fp"), F.col("_t.n")).alias("fpr"), ratio(F.col("tp"), F.col("_t.p")).alias("tpr"),
    )


def pr_points(df: DataFrame, keys: list[str] = (), y: str = "y_true", score: str = "anomaly_score") -> DataFrame:
    """Precision and recall at each distinct score."""
    keys = list(keys)
    return _curve(df, keys, y, score).select(
        *keys, F.col("score").alias("threshold"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("_t.p")).alias("recall"),
    )


def roc_auc(df: DataFrame, keys: list[str] = (), y: str = "y_true", score: str = "anomaly_score") -> DataFrame:
    """Area under the ROC curve, ties count half; null if a class is missing.

    A negative of some score loses against every positive with a higher score and ties with those of
    the same score, which the cumulative counts give directly.
    """
    keys = list(keys)
    points = curve_points(df, keys, y, score)
    wins = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return points.groupBy(*keys).agg((wins / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"))


def best_threshold(
    df: DataFrame, metric: str = "f1", min_precision: float = 0.3, min_recall: float = 0.5,
    steps: int = 100, y: str = "y_true", score: str = "anomaly_score",
) -> DataFrame:
    """Best of ``steps`` even thresholds between the lowest and the highest score; one row.

    Thresholds that put all rows on one side or miss a minimum do not count, the first of equals wins;
    0.5 with empty metrics if none is left.  Each row falls into the slot of the last threshold it
    reaches: the data is read once, into counts per score; the rest works on those and on ``steps`` rows.
    """
    counted = materialize(df.select(F.col(score).cast("double").alias("_v"), F.col(y).alias("_y")).groupBy("_v").agg(
        F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") != 1).alias("neg")), "scores")
    low, high = counted.agg(F.min("_v"), F.max("_v")).first()
    value = F.col("_v")
    lo, hi = F.lit(low).cast("double"), F.lit(high).cast("double")
    gap = F.lit(None if low is None else (high - low) / (steps - 1)).cast("double")

    def at(k: Column) -> Column:
        return F.when(k == steps - 1, hi).otherwise(lo + k * gap)

    guess = F.least(F.lit(steps - 1), F.greatest(F.lit(0), F.floor((value - lo) / F.nullif(gap, F.lit(0.0)))))
    # rounding can be off by one slot: settle it with the threshold values themselves
    slot = (
        F.when((guess < steps - 1) & (value >= at(guess + 1)), guess + 1)
        .when(value < at(guess), guess - 1)
        .otherwise(guess)
    )
    slots = (
        counted.groupBy(slot.alias("slot")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    # ``steps`` rows at most: gather them into one row and unfold the thresholds from it
    gathered = slots.agg(
        F.collect_list(F.struct("slot", "pos", "neg")).alias("s"),
        F.sum("pos").alias("p"), F.sum("neg").alias("n"),
    )

    def reached(field: str) -> Column:
        return F.aggregate(
            F.filter("s", lambda x: x["slot"] >= F.col("k")), F.lit(0).cast("long"), lambda a, x: a + x[field]
        )

    cells = (
        gathered.filter(hi > lo)
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
        .withColumns({"tp": reached("pos"), "fp": reached("neg"), "threshold": at(F.col("k"))})
        .withColumns({"fn": F.col("p") - F.col("tp"), "tn": F.col("n") - F.col("fp")})
    )
    goal = {
        "precision": F.col("precision"),
        "recall": F.col("recall"),
        "balanced": (F.col("precision") + F.col("recall")) / 2,
    }.get(metric, F.col("f1"))
    usable = (
        with_metrics(cells)
        .filter((F.col("tp") + F.col("fp") > 0) & (F.col("tn") + F.col("fn") > 0))
        .filter((F.col("precision") >= min_precision) & (F.col("recall") >= min_recall))
        .withColumn("goal", goal)
        .filter(F.col("goal") > 0)
    )
    best = F.min(F.struct((-F.col("goal")).alias("g"), "k", "threshold", "accuracy", "precision", "recall", "f1"))
    return usable.agg(best.alias("b")).select(
        F.coalesce("b.threshold", F.lit(0.5)).alias("threshold"),
        "b.accuracy", "b.precision", "b.recall", "b.f1",
    )


def meets_target(metrics: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """True where every metric reaches its target."""
    checks = [F.col(name) >= bound for name, bound in (targets or TARGETS).items()]
    return metrics.withColumn("meets_target", reduce(lambda a, b: a & b, checks))


def with_total(metrics: DataFrame) -> DataFrame:
    """Weighted overall total."""
    parts = [F.col(name) * w for name, w in TOTAL_WEIGHTS.items()]
    return metrics.withColumn("total", reduce(lambda a, b: a + b, parts))


def best_model(metrics: DataFrame) -> DataFrame:
    """The row with the highest total; the first name wins a tie."""
    return with_total(metrics).orderBy(F.desc("total"), "model").limit(1)


def best_by(metrics: DataFrame, name: str = "f1") -> DataFrame:
    """The row with the highest value of one metric; the first model name wins a tie."""
    return metrics.orderBy(F.desc(name), "model").limit(1)


def compare_models(metrics: DataFrame) -> DataFrame:
    """Metrics with the rank of each model by F1, accuracy, recall and precision.

    The table has one row per model, so an ungrouped window is safe here.
    """
    from pyspark.sql import Window as W

    return metrics.withColumns({
        f"rank_{name}": F.row_number().over(W.orderBy(F.desc(name), "model"))
        for name in ("f1", "accuracy", "recall", "precision")
    })
