import pytest
from pyspark.sql import functions as F

from logsieve.operators.windows import window_features
from logsieve.plans import compare, rows, sequences, temporal
from logsieve.sources.events import event_logs
from logsieve.tuning import recommended_conf

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def logs(spark):
    return event_logs(spark, SF)


def test_train_test_parts(logs):
    split = sequences.train_test(logs)
    n = logs.filter("not is_error").count()
    assert split.train.count() == int(n * 0.8) and split.train.filter("is_error").isEmpty()
    for part in split:
        size = part.count()
        row = part.agg(F.min("idx"), F.max("idx"), F.count_distinct("idx")).first()
        assert tuple(row) == (0, size - 1, size)
        stepped = part.alias("a").join(part.alias("b"), F.expr("a.idx + 1 = b.idx"))
        assert stepped.filter("a.timestamp > b.timestamp").isEmpty()
    few = sequences.train_test(logs, max_normal=200, max_test_normal=10, max_test_error=5)
    assert (few.train.count(), few.test.count()) == (160, 15)


def test_risk_report(logs):
    risks = sequences.risk_chain(logs, threshold=0.6)
    report = sequences.risk_report(risks, 3)
    totals = report["totals"].first()
    assert totals["total_anomalies"] == risks.count() > 0
    assert sum(report[v].count() for v in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")) == totals["total_anomalies"]
    assert report["top"].filter("rank > 3").isEmpty()
    lines = [r["value"] for r in sequences.summary_lines(risks).orderBy("position").collect()]
    assert lines[0] == f"anomalous sequences: {totals['total_anomalies']}" and len(lines) == 8


def test_comparison(logs):
    data = compare.prepare(logs)
    assert sum(part.count() for part in data) == logs.count()
    out = {r["model"]: r for r in compare.compare(logs).collect()}
    assert set(out) == {"ngram", "tfidf"}
    for r in out.values():
        assert r["tp"] + r["tn"] + r["fp"] + r["fn"] == data.test.count()
        assert 0 <= r["roc_auc"] <= 1
    # no sequence is three deviations off: the raw scores are spread, which still rank the lines
    assert out["tfidf"]["roc_auc"] != 0.5


@pytest.mark.parametrize("detector", ["copod", "autoencoder"])
def test_temporal(logs, detector):
    feats = window_features(logs, "6 hours")
    found = temporal.temporal_anomalies(feats, logs, detector, width="6 hours")
    ranked = found.sequences.orderBy("priority").collect()
    runs = feats.count() - 9
    assert 0 < len(ranked) <= runs * 0.1 + 1
    assert [r["priority"] for r in ranked] == list(range(1, len(ranked) + 1))
    assert sum(r["log_count"] for r in ranked) == found.logs.count()
    assert found.summary.first()["total_anomalies"] == len(ranked)


def test_row_comparison(logs):
    out = rows.evaluate(rows.prepare(logs), ("copod", "autoencoder")).collect()
    assert {r["model"] for r in out} == {"copod", "autoencoder"}
    assert all(r["roc_auc"] > 0.5 for r in out)


def test_recommended_conf():
    conf = recommended_conf(100 << 40, 8000)
    assert conf["spark.sql.shuffle.partitions"] == str((100 << 40) // (128 << 20))
    assert recommended_conf(1, 16)["spark.sql.shuffle.partitions"] == "16"


def test_sequence_models_side_by_side(spark, tmp_path):
    from logsieve.plans import compare, sequences as P
    from logsieve.sources.events import event_logs

    data = compare.prepare(event_logs(spark, "/root/testdata/sf0.001"))
    normal = data.train.filter("not problem").drop("idx").withColumnRenamed("class_idx", "idx")
    models = P.fit_all(normal, w=6, labelled=data.train)
    assert set(models) == {"tree", "tfidf", "classifier"}
    P.save(models, f"{tmp_path}/models")
    again = P.load(spark, f"{tmp_path}/models", tuple(models))
    for name in models:
        one, two = ({r[0]: r[1] for r in P.scores(data.test, m[name]).collect()} for m in (models, again))
        assert one.keys() == two.keys() and one and all(abs(one[k] - two[k]) < 1e-12 for k in one)
    found = P.detect_side_by_side(data.test, again, {"tfidf": 0.3, "tree": 0.5, "classifier": 0.3})
    sets = {name: {r.sequence_index for r in df.collect()} for name, df in found.items()}
    compared = P.compare_found(found)
    assert {r[0] for r in compared["all"].collect()} == set.intersection(*sets.values())
    assert {r.model: r.detected for r in compared["severity"].collect()} == {k: len(v) for k, v in sets.items() if v}
    later = P.detect_new(event_logs(spark, "/root/testdata/sf0.001"), {"tfidf": again["tfidf"]}, {"tfidf": 0.3})
    assert "max_severity_level" in later["tfidf"].columns
    try:
        P.fit_all(normal, ("classifier",))
        raise AssertionError("a classifier without errors was fitted")
    except ValueError:
        pass
