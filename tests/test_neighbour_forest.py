import numpy as np
import pytest
from pyspark.sql import functions as F

from logsieve.operators.detectors import lof, neighbour_forest as N

COLS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def cloud(spark):
    """Clusters of different density, copies of one row, rows that differ in the last digits only, and outliers far off."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(12, 4)) * 8
    x = np.concatenate([centre[rng.integers(0, 12, 5000)] + rng.normal(size=(5000, 4)) * rng.choice([0.2, 1.0], (5000, 1)),
                        np.tile([[1.0, 1.0, 1.0, 1.0]], (400, 1)), 1e4 + rng.normal(size=(40, 4)) * 1e-6, rng.normal(size=(10, 4)) * 60])
    frame = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double, d double")
    return frame.repartition(4).cache()


def test_halves_cover_every_row_once_and_stop_at_equal_points():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(300, 3)), rng.normal(size=(1000, 3))
    leaves = list(N._halves(rng, x, y, 60))
    assert sorted(np.concatenate([m for m, _ in leaves])) == list(range(300))
    assert all(len(t) <= 60 for _, t in leaves)
    same = list(N._halves(rng, x, np.ones((500, 3)), 60))
    assert [(len(m), len(t)) for m, t in same] == [(300, 500)]
    assert len(N.nearest_in_leaves(0, np.arange(0), x[:0], np.arange(1000), y, np.ones(1000, int), 5)) == 0


def test_trees_are_balanced():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4096, 5))
    tree = N._grow(rng, x, 5)
    sizes = np.bincount(N._leaf(x, *tree, 5), minlength=32)
    assert sizes.min() >= 126 and sizes.max() <= 130


def test_neighbours_by_forest(spark, cloud):
    pts = lof.points(cloud, COLS)
    n = pts.count()
    near = N.neighbours(pts, 10, n, pts, trees=6, group_points=700).cache()
    assert near.groupBy("point").count().filter("count <> 10").count() == 0
    assert near.filter("point = neighbour").count() == 0
    got = N.recall(pts, near, 10, every=1).first()
    assert got.points == n and got.recall >= 0.9
    assert got.recall > N.recall(pts, N.neighbours(pts, 10, n, pts, trees=1, group_points=700), 10, every=1).first().recall
    x = {r["point"]: np.array(r["x"]) for r in pts.collect()}
    some = near.filter("point % 40 = 0").collect()
    assert all(abs(r["dist"] - np.sqrt(np.square(x[r["point"]] - x[r["neighbour"]]).sum())) <= 1e-12 * (1 + r["dist"]) for r in some)
    again = N.neighbours(pts.repartition(3), 10, n, pts, trees=6, group_points=700)
    assert sorted(again.collect()) == sorted(near.collect())


def test_factors_by_forest_are_near_the_exact_ones(cloud):
    exact = {r["id"]: r["anomaly_score"] for r in lof.score(cloud, COLS, 10).collect()}
    forest = {r["id"]: r["anomaly_score"] for r in lof.score(cloud, COLS, 10, broadcast_points=0, trees=6).collect()}
    assert exact.keys() == forest.keys()
    ids = sorted(exact)
    a, b = np.array([exact[i] for i in ids]), np.array([forest[i] for i in ids])
    assert np.mean(np.abs(a - b) <= 0.02 * a) >= 0.95
    assert len(set(np.argsort(-a)[:20]) & set(np.argsort(-b)[:20])) >= 18


def test_new_rows_by_forest(cloud):
    train, new = cloud.filter("id % 5 <> 0"), cloud.filter("id % 5 = 0")
    exact = {r["id"]: r["anomaly_score"] for r in lof.score_new(new, train, COLS, 10).collect()}
    forest = {r["id"]: r["anomaly_score"] for r in lof.score_new(new, train, COLS, 10, broadcast_points=0, trees=6).collect()}
    assert exact.keys() == forest.keys()
    a, b = (np.array([m[i] for i in sorted(exact)]) for m in (exact, forest))
    assert np.mean(np.abs(a - b) <= 0.02 * a) >= 0.95
    assert lof.score_new(new.limit(0), train, COLS, 10, broadcast_points=0, trees=2).count() == 0
