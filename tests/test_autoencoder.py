import numpy as np
import pytest
from pyspark.sql import functions as F

from logsieve.operators.detectors import autoencoder, pca_recon
from logsieve.operators.evaluate import roc_auc
from logsieve.plans import windows as P
from logsieve.operators.windows import WINDOW_FEATURES

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def curve(spark):
    """Rows on a bent line, and strangers in the space around it that hardly leave the plane of the data."""
    rng = np.random.default_rng(2)
    t = rng.uniform(-1, 1, 900)
    on = np.column_stack([t, 2 * t**2 - 0.7, np.sin(3 * t)]) + rng.normal(0, 0.02, (900, 3))
    off = rng.uniform(-1, 1, (60, 3))
    rows = [(*map(float, r), 0) for r in on] + [(*map(float, r), 1) for r in off]
    return spark.createDataFrame(rows, "a double, b double, c double, y int").repartition(3)


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(0)
    sizes = [3, 5, 2, 5, 3]
    weights, x = autoencoder.first_weights(sizes, 1), rng.normal(size=(7, 3))
    loss, gradient = autoencoder.loss_and_gradient(weights, sizes, x)
    for k in range(len(weights)):
        step = np.zeros_like(weights)
        step[k] = 1e-6
        up, down = (autoencoder.loss_and_gradient(weights + s, sizes, x)[0] for s in (step, -step))
        assert (up - down) / 2e-6 == pytest.approx(gradient[k], abs=1e-6)


def test_bent_data(spark, curve):
    normal = curve.filter("y = 0")
    deep = autoencoder.score(curve, autoencoder.fit(normal, COLS, hidden=[12, 1, 12], rounds=25))
    flat = pca_recon.score(curve, pca_recon.fit(normal, COLS, components=1))

    def auc(scored):
        return roc_auc(scored.select(F.lit("m").alias("model"), F.col("y").alias("y_true"), "anomaly_score"), ["model"]).first()["roc_auc"]

    assert auc(deep) > 0.9 > auc(flat) + 0.05


def test_sizes_and_refusal(spark, curve):
    assert [autoencoder.hidden_layers(d) for d in (3, 8, 15)] == [[4, 1, 4], [16, 4, 16], [64, 32, 7, 32, 64]]
    assert [autoencoder.schedule(n) for n in (10, 60, 10**9)] == [(20, 8, 10), (30, 16, 10), (50, 32, 1)]
    with pytest.raises(ValueError):
        autoencoder.fit(curve.limit(9), COLS)


def test_window_detectors_share_one_contract(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(f"2025-07-02 {i // 60:02d}:{i % 60:02d}:00", *map(float, rng.normal(10, 2, len(WINDOW_FEATURES)))) for i in range(60)]
    names = ["time_window", *WINDOW_FEATURES]
    feats = spark.createDataFrame(rows, names).withColumn("time_window", F.to_timestamp_ntz("time_window"))
    state = P.fit(feats, ("neural_autoencoder", "ocsvm"))
    P.save(state, f"{tmp_path}/state")
    again = P.load(spark, f"{tmp_path}/state")
    for name in state.models:
        one, two = (P.score_model(feats, s, name).orderBy("time_window").select("anomaly_score", "is_anomaly").collect() for s in (state, again))
        assert one == two and 0 < sum(r.is_anomaly for r in one) <= 7
