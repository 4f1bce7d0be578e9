import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsieve.operators import embedding
from logsieve.operators.detectors import order_classifier, seq_classifier
from logsieve.operators.evaluate import roc_auc


def frame(spark, rows):
    return spark.createDataFrame([(i, t, e) for i, (t, e) in enumerate(rows)], "idx long, template string, is_error boolean").repartition(3)


def blocks(rng, n, w):
    """Blocks of the same templates; only their order tells the bad ones, whose last line is marked."""
    out = []
    while len(out) < n:
        bad = rng.random() < 0.4
        steps = ["open", "read", "check", "write", "flush", "close"]
        block = steps[::-1] if bad else steps
        out += [(t, bad and i == w - 1) for i, t in enumerate(block)]
    return out


def test_embedding_is_the_svd(spark):
    rng = random.Random(1)
    chain = [rng.choice("abcdefgh") if rng.random() < 0.5 else "abcdefgh"[i % 8] for i in range(900)]
    rows = frame(spark, [(t, False) for t in chain])
    matrix = embedding.mutual_information(embedding.follow_counts(rows, reach=2, bucket_rows=50)).collect()
    names = sorted(set(chain))
    dense = np.zeros((8, 8))
    for r in matrix:
        dense[names.index(r.a), names.index(r.b)] = r.v
    counts = np.zeros((8, 8))
    for i in range(len(chain) - 2):
        for k in (1, 2):
            counts[names.index(chain[i]), names.index(chain[i + k])] += 1
    with np.errstate(divide="ignore", invalid="ignore"):
        want = np.log(counts * counts.sum() / (counts.sum(1)[:, None] * counts.sum(0)))
    assert dense == pytest.approx(np.where(want > 0, want, 0))
    table, dims = embedding.template_embedding(rows, dims=8, reach=2, bucket_rows=50)
    got = {r.template: r for r in table.collect()}

    def side(name):  # templates outside the matrix on one side have no vector there
        return np.array([getattr(got[t], name) if t in got and getattr(got[t], name) else [0.0] * dims for t in names])

    assert side("before") @ side("after").T == pytest.approx(dense, abs=1e-6)


def test_order_is_seen(spark):
    rng = random.Random(6)
    w = 6
    train, test = frame(spark, blocks(rng, 1800, w)), frame(spark, blocks(rng, 900, w))
    deep, flat = order_classifier.fit(train, w, dims=6, bucket_rows=128), seq_classifier.fit(train, w, bucket_rows=128)
    truth = {r.sequence_index: r.label for r in order_classifier._pooled(test, deep.vectors, deep.dims, w, 128).collect()}

    def auc(module, fitted):
        scored = module.score(test, fitted, bucket_rows=128).filter("sequence_index % 6 = 0")
        labels = spark.createDataFrame([(k, int(v)) for k, v in truth.items()], "sequence_index long, y_true int")
        return roc_auc(scored.join(labels, "sequence_index").withColumn("model", F.lit("m")), ["model"]).first()["roc_auc"]

    assert auc(order_classifier, deep) > 0.95 > 0.75 > auc(seq_classifier, flat)
    one = frame(spark, [(t, False) for t in ["open", "read", "check", "write", "flush", "close"]])
    back = frame(spark, [(t, False) for t in ["close", "flush", "write", "check", "read", "open"]])
    first, second = (order_classifier.score(x, deep).first()["anomaly_score"] for x in (one, back))
    assert second > first + 0.2


def test_unknown_templates_and_short_tables(spark):
    rng = random.Random(6)
    fitted = order_classifier.fit(frame(spark, blocks(rng, 300, 4)), 4, dims=4)
    assert order_classifier.score(frame(spark, [("open", False)] * 3), fitted).count() == 0
    rows = order_classifier.score(frame(spark, [("never seen", False)] * 5), fitted).collect()
    assert len(rows) == 2 and all(0 < r.anomaly_score < 1 for r in rows)
