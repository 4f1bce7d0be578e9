"""Work that may not grow faster than the input: lines parsed once, rows ranked once, features made once."""

import random
from collections import Counter

from conftest import plan_of
from pyspark.sql import functions as F

from logsieve.operators import splits
from logsieve.operators.detectors import seq_classifier
from logsieve.operators.ordering import lay_out_logs
from logsieve.sources import events

LINE = "timestamp timestamp_ntz, file_path string, line_number long, level string, message string, is_error boolean"


def logs(spark, n=300, errors=0.3, seed=5):
    rng = random.Random(seed)
    rows = [(f"2025-07-02 10:{rng.randrange(60):02d}:00", "a.log", i, "INFO", f"step {i % 7}", rng.random() < errors) for i in range(n)]
    strings = spark.createDataFrame(rows, LINE.replace("timestamp_ntz", "string")).repartition(3)
    return strings.withColumn("timestamp", F.to_timestamp_ntz("timestamp"))


def test_lines_are_worked_out_once_for_their_layout(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(text):
        seen.add(1)
        return text

    laid = lay_out_logs(logs(spark).withColumn("message", noted("message")))
    assert laid.count() == 300 and seen.value == 300


def test_events_of_one_file_are_dealt_over_all_cores(spark, tmp_path):
    rows = spark.range(4000).selectExpr("id AS event_id", "timestamp_ntz'2025-07-02 10:00:00' AS ts", "id % 9 AS user_id", "'view' AS event_type", "'{}' AS props")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    dealt = events.dealt_events(source).withColumn("part", F.spark_partition_id())
    dealt.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/check").format("parquet").start(f"{tmp_path}/out").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 4000 and out.select("part").distinct().count() == spark.sparkContext.defaultParallelism


def test_nested_parts_by_hand(spark):
    for errors in (0.0, 0.3, 1.0):
        table = logs(spark, 211, errors)
        rows = sorted(table.collect(), key=lambda r: (r.timestamp, r.file_path, r.line_number))
        early, sizes, met, want = int(211 * 0.8), Counter(), Counter(), {}
        for r in rows[:early]:
            sizes[r.is_error] += 1
        for k, r in enumerate(rows):
            part = "test" if k >= early else "train" if met["early", r.is_error] < int(sizes[r.is_error] * (1 - 0.2)) else "valid"
            met["early", r.is_error] += 1
            want[r.line_number] = (part, met[part], met[part, r.is_error], r.is_error)
            met[part] += 1
            met[part, r.is_error] += 1
        got = {r.line_number: (r.split, r.idx, r.class_idx, r.problem) for r in splits.number_nested(table).collect()}
        assert got == want


def test_classifier_makes_its_features_once(spark, monkeypatch):
    given = []

    class Noting(seq_classifier.LogisticRegression):
        def fit(self, data):
            given.append(plan_of(data))
            return super().fit(data)

    monkeypatch.setattr(seq_classifier, "LogisticRegression", Noting)
    rows = logs(spark).select((F.col("line_number")).alias("idx"), F.col("message").alias("template"), "is_error")
    fitted = seq_classifier.fit(rows, w=3, bucket_rows=32)
    assert "Window" not in given[0] and "Scan parquet" in given[0]
    assert seq_classifier.score(rows, fitted, bucket_rows=32).count() == 298
