import numpy as np
import pytest
from pyspark.sql import functions as F

from logsieve.operators import ordering as O
from logsieve.operators import sequences as Q
from logsieve.operators import splits


def numbered(spark, n, parts=3):
    return spark.range(n).repartition(parts).select(
        F.col("id").alias("idx"), (F.col("id") * 7 % 11).alias("v"), (F.col("id") % 4 == 0).alias("is_error")
    )


@pytest.mark.parametrize("parts", [1, 7])
def test_dense_index_with_hot_key(spark, parts):
    # two thirds of the rows share one key value: the unique last key still splits them
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id")).alias("k"), "id").repartition(parts)
        laid = O.lay_out(df, ["k", "id"])
        sizes = [r["count"] for r in laid.groupBy(O.PART).count().collect()]
        assert max(sizes) < 3000 * 0.6
        rows = O.number_rows(laid).orderBy("idx").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert [r["idx"] for r in rows] == list(range(3000))
    assert [(r["k"], r["id"]) for r in rows] == sorted((r["k"], r["id"]) for r in rows)


def test_numbers_within_groups_and_filters(spark):
    laid = O.lay_out(numbered(spark, 500), ["idx"]).withColumnRenamed("idx", "pos")
    rows = O.number_rows_within(laid, ["is_error"], "r").orderBy("pos").collect()
    seen = {True: 0, False: 0}
    for r in rows:
        assert r["r"] == seen[r["is_error"]]
        seen[r["is_error"]] += 1
    kept = O.number_rows_within(laid.filter("v > 4"), [], "r").orderBy("pos").collect()
    assert [r["r"] for r in kept] == list(range(len(kept)))


def test_running_sums(spark):
    laid = O.lay_out(numbered(spark, 400), ["is_error", "idx"])
    rows = O.running_sums(laid, {"s": "v"}, ["is_error"]).orderBy("idx").collect()
    total = {True: 0, False: 0}
    for r in rows:
        total[r["is_error"]] += r["v"]
        assert r["s"] == total[r["is_error"]]


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    a = np.round(rng.normal(size=501), 1)
    df = spark.createDataFrame([(float(v), float(v) ** 2) for v in a], "a double, b double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r["feature"], r["prob"]): r["value"] for r in O.exact_quantiles(df, ["a", "b"], probs).collect()}
    for name, x in (("a", a), ("b", a ** 2)):
        for p in probs:
            assert got[name, p] == pytest.approx(np.quantile(x, p), abs=1e-12)


@pytest.mark.parametrize("n", [14, 15, 16, 200])
def test_sequences_for_any_bucket_size(spark, n):
    w, v = 15, [i * 7 % 11 for i in range(n)]
    want = {s: v[s:s + w] for s in range(max(n - w + 1, 0))}
    for size in (1, 15, 64, 1000):
        got = {r["sequence_index"]: r["sequence"] for r in Q.sequences(numbered(spark, n), "v", w, bucket_rows=size).collect()}
        assert got == want
    pairs = Q.next_event_pairs(numbered(spark, n), w, "v", bucket_rows=20).collect()
    assert {r["sequence_index"]: (r["sequence"], r["next_value"]) for r in pairs} == {
        s: (v[s:s + w], v[s + w]) for s in range(max(n - w, 0))
    }


def test_spread_scores(spark):
    marks = {3: 2.0, 10: 1.0, 90: 5.0}
    scored = spark.createDataFrame(list(marks.items()), "sequence_index long, anomaly_score double")
    for size in (15, 32, 4096):
        rows = Q.spread_scores(numbered(spark, 100), scored, 15, bucket_rows=size).collect()
        assert len(rows) == 100
        for r in rows:
            best = max([s for i, s in marks.items() if i <= r["idx"] <= i + 14], default=None)
            assert (r["y_pred"], r["anomaly_score"]) == (int(best is not None), best or 0.0)


def test_range_join_by_frame(spark):
    starts = spark.createDataFrame([(0,), (7,), (95,)], "sequence_index long")
    aggs = {"n": F.count("v"), "total": F.sum("v"), "vs": F.collect_list("v")}
    for size in (15, 4096):
        rows = Q.for_sequences(starts, numbered(spark, 100).drop("is_error"), 15, aggs, {"third": ("v", 2)}, size).collect()
        v = [i * 7 % 11 for i in range(100)]
        assert {r["sequence_index"]: (r["n"], r["total"], r["vs"]) for r in rows} == {
            s: (len(v[s:s + 15]), sum(v[s:s + 15]), v[s:s + 15]) for s in (0, 7, 95)
        }
        assert {r["sequence_index"]: r["third"] for r in rows} == {s: v[s + 2] for s in (0, 7, 95)}


def by_split(df):
    return {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}


@pytest.mark.parametrize("n", [10, 11, 99])
def test_split_sizes(spark, n):
    train, valid = int(n * 0.8), int(n * 0.1)
    assert by_split(splits.split_by_time(numbered(spark, n))) == {"train": train, "valid": valid, "test": n - train - valid}


@pytest.mark.parametrize("chunk", [None, 7, 10, 16, 1000])
def test_chunked_split(spark, chunk):
    n = 99
    test_start, valid_start = int(n * 0.8), int(int(n * 0.8) * 0.8)
    want = []
    for i in range(n):
        start = i - i % chunk if chunk else i
        end = min(start + chunk, n) if chunk else i + 1
        at = start if end <= test_start else i
        want.append("test" if i >= test_start else "valid" if at >= valid_start else "train")
    rows = splits.split_chunked(numbered(spark, n), chunk_rows=chunk).orderBy("idx").collect()
    assert [r["split"] for r in rows] == want


def test_samples(spark):
    idx = lambda df: sorted(r["idx"] for r in df.collect())
    assert idx(splits.sample_systematic(numbered(spark, 100), 30)) == list(range(0, 90, 3))
    assert idx(splits.sample_systematic(numbered(spark, 20), 30)) == list(range(20))
    for n, k in ((100, 7), (1000, 999), (50, 50), (30, 80), (77, 2), (9, 1)):
        want = sorted(set(np.linspace(0, n - 1, k, dtype=int))) if k <= n else list(range(n))
        assert idx(splits.sample_even(numbered(spark, n), k)) == want
    a = splits.sample_random(numbered(spark, 200), 20, "idx")
    assert idx(a) == idx(splits.sample_random(numbered(spark, 200, 5), 20, "idx")) and a.count() == 20


def test_row_level_plans_have_no_single_task(spark):
    from conftest import plan_of

    laid = O.lay_out(numbered(spark, 1000), ["idx"]).drop("idx")
    plan = plan_of(O.number_rows(laid).groupBy("v").count())
    # the only gathered input is one row per partition
    assert plan.count("SinglePartition") <= 1
    frames = plan_of(Q.sequences(numbered(spark, 100), "v", 15))
    assert "SinglePartition" not in frames and "CartesianProduct" not in frames


def test_rows_without_a_time_come_last(spark):
    rows = [("2025-01-01 00:00:02", "a", 1), (None, "b", 2), ("2025-01-01 00:00:01", "a", 3), (None, "a", 9), (None, "a", 4)]
    logs = spark.createDataFrame(rows, "t string, file_path string, line_number long").selectExpr(
        "cast(t as timestamp_ntz) as timestamp", "file_path", "line_number")
    got = [r["line_number"] for r in O.index_logs(logs).orderBy("idx").collect()]
    assert got == [3, 1, 4, 9, 2]
