import numpy as np
import pytest
from pyspark.sql import functions as F

from logsieve.operators import baseline as B
from logsieve.operators import vocabulary as V
from logsieve.operators.detectors import copod, iforest, lof, ngram_next, pca_recon, rff_ocsvm, seq_classifier, tfidf_seq

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1000, 3))
    x[:, 2] = x[:, 0] + 0.1 * x[:, 2]
    far = rng.normal(size=(20, 3)) + np.array([6.0, -6.0, -6.0])
    rows = [(i, *map(float, v), int(i >= 1000)) for i, v in enumerate(np.vstack([x, far]))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int").repartition(4).cache()


def hits(scored, n=20):
    return sum(r["y"] for r in scored.orderBy(F.desc("anomaly_score")).limit(n).collect())


def test_isolation_forest(planted):
    model = iforest.fit(planted, COLS, "id")
    assert model.feature.shape[0] == 100 and model.sample == 256 and model.feature.shape[1] <= 511
    scored = iforest.score(planted, model)
    assert hits(scored) >= 19
    ends = scored.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert 0 < ends[0] < ends[1] < 1
    again = iforest.fit(planted.repartition(2), COLS, "id")
    assert np.array_equal(model.threshold, again.threshold)
    flagged = B.flag_top(scored, scored).agg(F.sum("is_anomaly")).first()[0]
    assert flagged == 102


def test_path_length_formula():
    assert iforest.average_path(1) == 0 and iforest.average_path(2) == 1
    assert float(iforest.average_path(256)) == pytest.approx(10.24, abs=0.01)


def test_pca_reconstruction(spark, planted):
    scored = pca_recon.score(planted, pca_recon.fit(planted.filter("y = 0"), COLS, components=2))
    assert hits(scored) >= 19
    with pytest.raises(ValueError):
        pca_recon.fit(planted.limit(9), COLS)
    assert [pca_recon.bottleneck(d) for d in (1, 3, 5, 8, 15, 40)] == [1, 1, 2, 4, 7, 16]


def test_one_class_svm(planted):
    scored = rff_ocsvm.score(planted, rff_ocsvm.fit(planted.filter("y = 0"), COLS))
    assert hits(scored, 40) >= 18


def brute_lof(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, near, 1)
    reach = np.maximum(dist, dist[:, -1][near])
    lrd = 1 / (reach.mean(1) + 1e-10)
    return lrd[near].mean(1) / lrd


@pytest.mark.parametrize("limits", [{}, {"broadcast_points": 10, "cell_points": 40}])
def test_lof_is_exact(planted, limits):
    some = planted.filter("id % 4 = 0 or y = 1")
    rows = lof.score(some, COLS, 10, **limits).orderBy("id").collect()
    want = brute_lof(np.array([[r[c] for c in COLS] for r in rows]), 10)
    assert np.allclose([r["anomaly_score"] for r in rows], want, atol=1e-9)


def test_lof_with_a_hot_value(spark):
    rng = np.random.default_rng(2)
    x = [[1.0, 1.0]] * 60 + rng.normal(size=(60, 2)).tolist() + [[9.0, 9.0]]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(x)], "id int, a double, b double")
    rows = lof.score(df, ["a", "b"], 5).orderBy("id").collect()
    assert len(rows) == 121
    assert {round(r["anomaly_score"], 9) for r in rows[:60]} == {1.0}
    assert np.allclose([r["anomaly_score"] for r in rows[60:]], brute_lof(np.array(x), 5)[60:], rtol=1e-6)


def brute_copod(x, train):
    def tail(col, base):
        return -np.log(np.maximum((base[None, :] <= col[:, None]).sum(1), 1) / len(base))

    left = np.column_stack([tail(c, b) for c, b in zip(x.T, train.T)])
    right = np.column_stack([tail(-c, -b) for c, b in zip(x.T, train.T)])
    m = train - train.mean(0)
    skew = (m ** 3).mean(0) / (m ** 2).mean(0) ** 1.5
    return np.max([left.sum(1), right.sum(1), np.where(skew < 0, left, right).sum(1)], axis=0)


def test_copod(planted):
    rows = copod.score(planted, COLS, "id").join(planted, "id").orderBy("id").collect()
    x = np.array([[r[c] for c in COLS] for r in rows])
    assert np.allclose([r["anomaly_score"] for r in rows], brute_copod(x, x))
    marked = planted.withColumn("train", F.col("y") == 0)
    rows = copod.score(marked, COLS, "id", "train").join(planted, "id").orderBy("id").collect()
    assert np.allclose([r["anomaly_score"] for r in rows], brute_copod(x, x[:1000]))


MESSAGES = ["user 1 logged in", "cache refresh took 5 ms", "job done", "open /tmp/x now", "connection closed by peer"]


def log_rows(spark, n, odd=()):
    rng = np.random.default_rng(5)
    picks = rng.choice(4, n, p=[0.4, 0.3, 0.2, 0.1])
    rows = [(i, MESSAGES[4] if i in odd else MESSAGES[picks[i]], i in odd) for i in range(n)]
    df = spark.createDataFrame(rows, "idx long, message string, is_error boolean").repartition(3)
    return V.with_template(df).withColumns({"timestamp": F.timestamp_seconds("idx"), "file_path": F.lit("f"), "line_number": F.col("idx")})


def brute_tfidf(train, test, w):
    """Dense sequences, spelled out."""
    import re
    from collections import Counter

    docs = sorted(set(train))
    grams = {}
    for d in docs:
        ws = re.findall(r"\w\w+", d.lower())
        grams[d] = Counter(ws + [" ".join(p) for p in zip(ws, ws[1:])])
    total = Counter()
    for g in grams.values():
        total.update(g)
    terms = sorted(sorted(total, key=lambda t: (-total[t], t))[:100])
    df = {t: sum(t in g for g in grams.values()) for t in terms}
    vec = {}
    for d in docs:
        v = np.array([grams[d][t] * (np.log((1 + len(docs)) / (1 + df[t])) + 1) for t in terms])
        vec[d] = v / (np.linalg.norm(v) or 1)
    zero = np.zeros(len(terms))
    cube = lambda rows: np.array([[vec.get(r, zero) for r in rows[i:i + w]] for i in range(len(rows) - w + 1)])
    fit = cube(train)
    mean, std = fit.mean((0, 1)), fit.std((0, 1)) + 1e-8
    return np.abs((cube(test).mean(1) - mean) / std).max(1)


@pytest.mark.parametrize("w", [4, 15])
def test_tfidf_sequences(spark, w):
    train, test = log_rows(spark, 90), log_rows(spark, 60, odd=set(range(20, 32)))
    text = lambda df: [r["template"] for r in df.orderBy("idx").collect()]
    want = brute_tfidf(text(train), text(test), w)
    fitted = tfidf_seq.fit(train, w)
    for size in (16, 4096):
        rows = tfidf_seq.score(test, fitted, size).orderBy("sequence_index").collect()
        assert [r["sequence_index"] for r in rows] == list(range(60 - w + 1))
        assert np.allclose([r["max_z_score"] for r in rows], want)
    found = tfidf_seq.detect(test, fitted, 1.0)
    assert found.count() == (want > 1.0).sum()


def test_weighted_cells_identity():
    for n in range(1, 40):
        for w in range(1, n + 1):
            counted = np.zeros(n, int)
            for s in range(n - w + 1):
                counted[s:s + w] += 1
            assert counted.tolist() == [min(i + 1, w, n - i, n - w + 1) for i in range(n)]


def test_ngram_finds_the_odd_follower(spark):
    rows = [(i, MESSAGES[i % 3], False) for i in range(90)]
    base = spark.createDataFrame(rows, "idx long, message string, is_error boolean")
    more = {"timestamp": F.timestamp_seconds("idx"), "file_path": F.lit("f"), "line_number": F.col("idx")}
    train = V.with_template(base).withColumns(more)
    test = train.withColumn("template", F.when(F.col("idx") == 50, "never seen").otherwise(F.col("template")))
    scored = ngram_next.score(test, ngram_next.fit(train, w=10, order=2))
    by_start = {r["sequence_index"]: r for r in scored.collect()}
    assert sorted(by_start) == list(range(80))
    assert by_start[40]["actual_template"] == ngram_next.UNKNOWN
    assert max(by_start, key=lambda s: by_start[s]["anomaly_score"]) == 40
    assert by_start[0]["predicted_template"] == by_start[0]["actual_template"]
    assert by_start[0]["prediction_prob"] > 0.85


def test_sequence_classifier(spark):
    train = log_rows(spark, 200, odd=set(range(60, 75)) | set(range(150, 165)))
    fitted = seq_classifier.fit(train, 5)
    scored = {r["sequence_index"]: r["anomaly_score"] for r in seq_classifier.score(train, fitted).collect()}
    assert min(scored[s] for s in range(60, 70)) > 0.5 > max(scored[s] for s in range(0, 50))


def test_copod_and_lof_score_new_rows_against_training(planted):
    """New rows never change each other's scores: a batch scored alone equals its rows scored together."""
    train, new = planted.filter("id < 900"), planted.filter("id >= 900")
    rows = copod.score_new(new, train, COLS, "id").orderBy("id").collect()
    alone = copod.score_new(new.filter("id = 1010"), train, COLS, "id").first()["anomaly_score"]
    assert [r["anomaly_score"] for r in rows if r["id"] == 1010] == [alone]
    x = np.array([[r[c] for c in COLS] for r in planted.orderBy("id").collect()])
    assert np.allclose([r["anomaly_score"] for r in rows], brute_copod(x, x[:900])[900:])
    for limits in ({}, {"broadcast_points": 10, "cell_points": 100}):
        got = {r["id"]: r["anomaly_score"] for r in lof.score_new(new, train, COLS, 10, **limits).collect()}
        for i in (905, 950, 1010):  # by definition, from brute-force distances to the training rows
            want = brute_new_lof(x[:900], x[i], 10)
            assert abs(got[i] - want) < 1e-6 * abs(want)


def brute_new_lof(train, row, k):
    d = np.sqrt(((train[:, None] - train[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    k_dist = np.take_along_axis(d, near, 1)[:, -1]
    lrd = 1 / (np.maximum(np.take_along_axis(d, near, 1), k_dist[near]).mean(1) + 1e-10)
    own = np.sqrt(((train - row) ** 2).sum(-1))
    mine = np.argsort(own, kind="stable")[:k]
    return lrd[mine].mean() * (np.maximum(own[mine], k_dist[mine]).mean() + 1e-10)
