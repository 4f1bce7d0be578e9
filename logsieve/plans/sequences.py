"""Sequence analysis: train on normal lines -> anomalous sequences -> severity -> risk -> report."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..operators import risks as R
from ..operators import severities as S
from ..operators import overlap as O
from ..operators.detectors import context_tree, ngram_next, order_classifier, seq_classifier, tfidf_seq
from ..operators.ordering import PART, POS, lay_out_logs, number_rows, number_rows_within, row_count
from ..operators.sequences import for_sequences
from ..operators.splits import part_of, sample_systematic
from ..operators.vocabulary import with_template
from ..scratch import materialize
from ..sources.sinks import load_state, save_state

WIDTH = 15
DETECTORS = {
    "tfidf": tfidf_seq, "ngram": ngram_next, "tree": context_tree, "classifier": order_classifier, "bag_classifier": seq_classifier,
}
BOTH_LABELS = ("classifier", "bag_classifier")
COLUMNS = ["timestamp", "file_path", "line_number", "level", "message", "is_error", "template"]


class Split(NamedTuple):
    train: DataFrame
    test: DataFrame


def train_test(
    logs: DataFrame, share: float = 0.8, max_normal: int | None = None,
    max_test_normal: int | None = None, max_test_error: int | None = None,
) -> Split:
    """Train: the first ``share`` of the normal lines.  Test: the other normal lines and all errors.

    Both come with ``idx``, dense in time order.  The three limits take every k-th line and are off by
    default.
    """
    laid = lay_out_logs(with_template(logs).select(*COLUMNS))
    ranked = number_rows_within(number_rows(laid, "_all"), ["is_error"], "_rank")
    if max_normal is max_test_normal is max_test_error is None:
        # Both parts are numbered and written in one pass: the rows of either class before a row follow
        # from its position and its rank, and so do the test rows before it.
        train_end = part_of(row_count(laid.filter(~F.col("is_error"))), share)
        others = F.col("_all") - F.col("_rank")
        errors_before = F.when(F.col("is_error"), F.col("_rank")).otherwise(others)
        normal_before = F.when(F.col("is_error"), others).otherwise(F.col("_rank"))
        in_test = F.col("is_error") | (F.col("_rank") >= train_end)
        test_idx = errors_before + F.greatest(normal_before - train_end, F.lit(0))
        sided = ranked.withColumns({"in_test": in_test, "idx": F.when(in_test, test_idx).otherwise(F.col("_rank"))})
        parted = materialize(sided.drop("_all", "_rank", PART, POS), "train_test")
        return Split(*[parted.filter(side).drop("in_test") for side in (~F.col("in_test"), F.col("in_test"))])
    normal, errors = ranked.filter(~F.col("is_error")), ranked.filter("is_error")
    if max_normal is not None:
        normal = number_rows_within(sample_systematic(normal, max_normal, "_rank"), [], "_rank")
        total = row_count(normal)
    else:
        total = row_count(laid.filter(~F.col("is_error")))
    train_end = part_of(total, share)
    train = normal.filter(F.col("_rank") < train_end).withColumnRenamed("_rank", "idx")
    rest = normal.filter(F.col("_rank") >= train_end)
    if max_test_normal is not None:
        rest = sample_systematic(rest.withColumn("_rank", F.col("_rank") - train_end), max_test_normal, "_rank")
    if max_test_error is not None:
        errors = sample_systematic(errors, max_test_error, "_rank")
    numbered = number_rows_within(rest.unionByName(errors).drop("_rank", "_all"), [], "idx")
    return Split(
        materialize(train.drop("_all", PART, POS), "train"), materialize(numbered.drop(PART, POS), "test")
    )


def fit(train: DataFrame, detector: str = "tfidf", w: int = WIDTH, **options):
    """``train``: rows with ``idx`` and ``template``."""
    if detector not in DETECTORS:
        raise ValueError(f"unknown detector {detector!r}")
    return DETECTORS[detector].fit(train, w=w, **options)


def _module(fitted):
    return next(m for m in DETECTORS.values() if isinstance(fitted, m.Fitted))


def detect(test: DataFrame, fitted, threshold: float | None = None) -> DataFrame:
    """Anomalous sequences with the score of the fitted detector."""
    module = _module(fitted)
    return module.detect(test, fitted) if threshold is None else module.detect(test, fitted, threshold)


def scores(test: DataFrame, fitted) -> DataFrame:
    """(sequence_index, anomaly_score) of all sequences."""
    if isinstance(fitted, tfidf_seq.Fitted):
        scored = tfidf_seq.with_anomaly_score(tfidf_seq.score(test, fitted))
    else:
        scored = _module(fitted).score(test, fitted)
    return scored.select("sequence_index", "anomaly_score")


def with_severity(anomalies: DataFrame, test: DataFrame, w: int = WIDTH) -> DataFrame:
    """Severity of the rows of each sequence."""
    slim = anomalies.select("sequence_index", "anomaly_score")
    return S.attach_sequence_severity(slim, test, w)


def sequence_anomalies(train: DataFrame, test: DataFrame, detector: str = "tfidf", w: int = WIDTH, **options) -> DataFrame:
    """Anomalous sequences with severity and priority."""
    return S.prioritize(with_severity(detect(test, fit(train, detector, w, **options)), test, w))


def summary(anomalies: DataFrame) -> DataFrame:
    return S.severity_summary(anomalies, "max_severity_level", "max_severity_score")


def analyse_risk(anomalies: DataFrame, test: DataFrame, w: int = WIDTH) -> DataFrame:
    """Sequence anomalies with details, risk score and risk level."""
    return R.with_risk(R.sequence_details(anomalies, test, w))


def describe(anomalies: DataFrame, test: DataFrame, w: int = WIDTH) -> DataFrame:
    """Severity and details of each sequence together: the rows are shuffled once for both."""
    rows = S.with_score(test.select("idx", "level", "message"))
    packed = for_sequences(
        anomalies.select("sequence_index", "anomaly_score"), rows, w,
        {**S.severity_aggs(), **R.detail_aggs()}, R.FIRST_MESSAGES,
    )
    return R.unpack_details(S.fill_severity(packed))


def risk_report(risks: DataFrame, k: int = 10) -> dict[str, DataFrame]:
    """Report tables: totals, distribution, the top of each level and one frame per level."""
    return {
        "totals": R.risk_totals(risks),
        "distribution": R.risk_distribution(risks),
        "top": R.top_by_risk(risks, k),
        **R.risk_slices(risks),
    }


def summary_lines(risks: DataFrame) -> DataFrame:
    """(position, value) rows of a short text report; see ``sinks.write_text_report``."""
    totals = R.risk_totals(risks)
    counts = [
        F.format_string(f"{v}: %d", f"{v.lower()}_anomalies") for v in R.RISK_LEVELS
    ]
    lines = F.array(
        F.format_string("anomalous sequences: %d", "total_anomalies"), *counts,
        F.format_string("mean risk: %.2f", F.coalesce("avg_risk_score", F.lit(0.0))),
        F.format_string("highest risk: %.2f", F.coalesce("max_risk_score", F.lit(0.0))),
    )
    return totals.select(F.posexplode(lines).alias("position", "value"))


def risk_chain(logs: DataFrame, w: int = WIDTH, share: float = 0.8, threshold: float | None = None) -> DataFrame:
    """Raw parsed logs to risk-rated sequences."""
    split = train_test(logs, share)
    found = detect(split.test, fit(split.train, "tfidf", w), threshold)
    return R.with_risk(describe(found, split.test, w))


# ---- several fitted models side by side ------------------------------------------------------------

def fit_all(train: DataFrame, detectors: tuple[str, ...] = ("tree", "tfidf", "classifier"), w: int = WIDTH,
            labelled: DataFrame | None = None) -> dict:
    """Fitted models by name.  Those that learn from both labels are fitted on ``labelled``: indexed lines of both classes."""
    if labelled is None and set(detectors) & set(BOTH_LABELS):
        raise ValueError("a classifier needs lines of both classes")
    return {name: fit(labelled if name in BOTH_LABELS else train, name, w) for name in detectors}


def detect_side_by_side(
    test: DataFrame, models: dict, thresholds: dict[str, float] | None = None, severity: bool = True,
) -> dict[str, DataFrame]:
    """What each model finds in the same lines, with the severity of the sequences; written once per model."""
    found = {}
    for name, fitted in models.items():
        rows = detect(test, fitted, (thresholds or {}).get(name)).select("sequence_index", "anomaly_score")
        found[name] = materialize(with_severity(rows, test, fitted.w) if severity else rows, f"found_{name}")
    return found


def compare_found(found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Sequences that all models found, those that one alone found, and detections by model and severity."""
    return {"all": O.found_by_all(found), "one": O.found_by_one(found), "severity": O.severity_by_model(found)}


# fields of a fitted model that are numbers; all others are tables
NUMBERS = ("w", "order", "alpha", "depth", "dims", "weights", "intercept")


def save(models: dict, path: str, mode: str = "errorifexists") -> None:
    """Fitted models as Parquet tables below ``path/name``; their numbers as one row."""
    import json
    from dataclasses import fields

    for name, fitted in models.items():
        if isinstance(fitted, seq_classifier.Fitted):
            raise ValueError("the bag of counts holds a model of Spark, which is saved by its own writer")
        values = {f.name: getattr(fitted, f.name) for f in fields(fitted)}
        tables = {k: v for k, v in values.items() if k not in NUMBERS}
        kind = next(k for k, m in DETECTORS.items() if isinstance(fitted, m.Fitted))
        numbers = json.dumps({k: v for k, v in values.items() if k in NUMBERS})
        spark = next(iter(tables.values())).sparkSession
        tables["settings"] = spark.createDataFrame([(kind, numbers)], "kind string, numbers string")
        save_state(tables, f"{path}/{name}", mode)


def load(spark, path: str, names: tuple[str, ...]) -> dict:
    """The models saved under these names."""
    import json

    models = {}
    for name in names:
        tables = load_state(spark, f"{path}/{name}")
        settings = tables.pop("settings").first()
        models[name] = DETECTORS[settings["kind"]].Fitted(**tables, **json.loads(settings["numbers"]))
    return models


def detect_new(logs: DataFrame, models: dict, thresholds: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """Later log lines scored with what was fitted (and maybe saved) before."""
    laid = lay_out_logs(with_template(logs).select(*COLUMNS))
    return detect_side_by_side(materialize(number_rows(laid).drop(PART, POS), "later"), models, thresholds)
