import pytest
from pyspark.sql import functions as F

from logsieve.operators import ensemble as N
from logsieve.operators import evaluate as E
from logsieve.operators import overlap

# run, model, accuracy, precision, recall, f1, specificity, tp, tn, fp, fn as published
CELLS = [
    ("0n", .0702, .0702, .9993, .1311, .0000, 1403, 0, 18596, 1),
    ("0t", .8980, .0607, .0313, .0413, .9634, 44, 17915, 681, 1360),
    ("1n", .0720, .0720, .9997, .1343, .0000, 3598, 0, 46401, 1),
    ("1t", .8802, .0795, .0628, .0702, .9436, 226, 43783, 2618, 3373),
    ("2t", .8771, .0802, .0675, .0733, .9399, 243, 43614, 2787, 3356),
    ("3c", .9280, .0000, .0000, .0000, 1.0000, 0, 46401, 0, 3599),
    ("4t", .8835, .0729, .0528, .0613, .9480, 190, 43986, 2415, 3409),
]
TOTALS = {"0t": .2983, "1t": .3126, "2t": .3140, "4t": .3074}


def test_published_metrics(spark):
    cells = spark.createDataFrame([(c[0], *c[6:]) for c in CELLS], "model string, tp long, tn long, fp long, fn long")
    rows = {r["model"]: r for r in E.with_total(E.meets_target(E.with_metrics(cells))).collect()}
    for name, acc, prec, rec, f1, spec, *_ in CELLS:
        got = rows[name]
        assert [round(got[c], 4) for c in ("accuracy", "precision", "recall", "f1", "specificity")] == [acc, prec, rec, f1, spec]
        assert got["meets_target"] is False
    for name, total in TOTALS.items():
        assert round(rows[name]["total"], 4) == total
    assert E.best_model(E.with_metrics(cells)).first()["model"] == "2t"


def frame(spark, y, s, p=None):
    p = p or [int(v > 0.5) for v in s]
    return spark.createDataFrame(list(zip(y, [float(v) for v in s], p)), "y_true int, anomaly_score double, y_pred int").repartition(3)


def auc(spark, y, s):
    return E.roc_auc(frame(spark, y, s)).first()["roc_auc"]


def test_auc(spark):
    y = [0, 0, 1, 1, 0, 1]
    assert auc(spark, y, [.1, .2, .8, .9, .3, .7]) == 1.0
    assert auc(spark, y, [.9, .8, .2, .1, .7, .3]) == 0.0
    assert auc(spark, y, [.5] * 6) == 0.5
    s = [.1, .4, .4, .9, .5, .5]
    pairs = [(a > b) + (a == b) / 2 for a, t in zip(s, y) if t for b, u in zip(s, y) if not u]
    assert auc(spark, y, s) == pytest.approx(sum(pairs) / len(pairs))
    assert auc(spark, y, [-v for v in s]) == pytest.approx(1 - sum(pairs) / len(pairs))
    assert auc(spark, [1, 1], [.2, .3]) is None


def test_one_class_cells(spark):
    row = E.classification_metrics(frame(spark, [0, 0], [.1, .2])).first()
    assert (row["tp"], row["tn"], row["fp"], row["fn"]) == (0, 2, 0, 0)
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"]) == (1.0, 0.0, 0.0, 0.0)


def test_curves(spark):
    df = frame(spark, [1, 0, 1, 0], [.9, .8, .8, .1])
    roc = [(r["threshold"], r["fpr"], r["tpr"]) for r in E.roc_points(df).orderBy(F.desc("threshold")).collect()]
    assert roc == [(.9, 0.0, .5), (.8, .5, 1.0), (.1, 1.0, 1.0)]
    pr = [(r["precision"], r["recall"]) for r in E.pr_points(df).orderBy(F.desc("threshold")).collect()]
    assert pr == [(1.0, .5), (pytest.approx(2 / 3), 1.0), (.5, 1.0)]


def test_best_threshold(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    s = np.round(y * 0.4 + rng.random(300), 2)
    df = frame(spark, y.tolist(), s.tolist())
    for metric in ("f1", "precision", "recall", "balanced"):
        best, at = 0, None
        for t in np.linspace(s.min(), s.max(), 100):
            p = s >= t
            tp, fp, fn = (p & (y == 1)).sum(), (p & (y == 0)).sum(), (~p & (y == 1)).sum()
            if p.all() or not p.any():
                continue
            prec, rec = tp / max(tp + fp, 1), tp / max(tp + fn, 1)
            if prec < .3 or rec < .5:
                continue
            goal = {"f1": 2 * tp / (2 * tp + fp + fn), "precision": prec, "recall": rec, "balanced": (prec + rec) / 2}[metric]
            if goal > best + 1e-12:
                best, at = goal, t
        assert E.best_threshold(df, metric).first()["threshold"] == pytest.approx(at)
    none = E.best_threshold(df, "f1", 0.999, 0.999).first()
    assert none["threshold"] == 0.5 and none["f1"] is None
    assert E.best_threshold(frame(spark, [0, 1], [.4, .4])).first()["threshold"] == 0.5


def test_votes(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 1)], "a int, b int")
    rows = df.select(N.majority(["a", "b"]), N.any_vote(["a", "b"]), N.all_votes(["a", "b"])).collect()
    assert [tuple(r) for r in rows] == [(1, 1, 0), (0, 0, 0), (1, 1, 1)]
    with pytest.raises(ValueError):
        N.ensemble(df, ["a"], ["b"], "other")


def test_stacking_separates(spark):
    rows = [(i, int(i >= 80), float(i), float(-i)) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, y int, s double, t double")
    out = N.stack_predict(df, ["s", "t"], N.fit_stack(df, ["s", "t"]))
    assert E.roc_auc(out, y="y", score="ensemble_score").first()["roc_auc"] == 1.0


def test_overlap(spark):
    sets = {"a": [1, 2, 3], "b": [2, 3, 4], "c": [3, 5]}
    frames = {k: spark.createDataFrame([(i, "LOW") for i in v], "sequence_index long, max_severity_level string") for k, v in sets.items()}
    assert [r[0] for r in overlap.found_by_all(frames).collect()] == [3]
    assert sorted((r[0], r[1]) for r in overlap.found_by_one(frames).collect()) == [("a", 1), ("b", 4), ("c", 5)]
    assert {r["model"]: r["low"] for r in overlap.severity_by_model(frames).collect()} == {"a": 3, "b": 3, "c": 2}
