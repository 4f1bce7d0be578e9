import random

import pytest
from pyspark.sql import Window, functions as F

from logsieve.operators.detectors import context_tree, tfidf_seq
from logsieve.operators.vocabulary import with_template
from logsieve.streaming import event_time_for_streams
from logsieve.streaming import sequences as S

W = 4
SCHEMA = "timestamp timestamp_ntz, file_path string, line_number long, level string, message string"


def lines(spark, n=260, seed=3):
    """Lines of three files of very different length, some of them failures."""
    rng = random.Random(seed)
    texts = ["user 7 signed in", "cache refresh took 12 ms", "GET /api/v1/items/5 returned: 200", "queue drained", "java.lang.OutOfMemoryError: Java heap space"]
    count = {}
    rows = []
    for i in range(n):
        name = rng.choices(["a.log", "b.log", "c.log"], [20, 5, 1])[0]
        count[name] = count.get(name, 0) + 1
        text = rng.choices(texts, [4, 4, 3, 3, 1])[0]
        rows.append((f"2025-07-02 10:{i // 60:02d}:{i % 60:02d}", name, count[name], "ERROR" if "Error" in text else "INFO", text))
    return rows


def frame(spark, rows):
    strings = spark.createDataFrame(rows, SCHEMA.replace("timestamp_ntz", "string"))
    return strings.withColumn("timestamp", F.to_timestamp_ntz("timestamp"))


@pytest.fixture(scope="module")
def models(spark):
    logs = with_template(frame(spark, lines(spark, seed=8))).withColumn("idx", F.row_number().over(Window.orderBy("timestamp", "file_path")).cast("long") - 1)
    return context_tree.fit(logs, w=W), tfidf_seq.fit(logs, w=W)


def plain(df):
    cols = ["file_path", "position", "line_number", "max_severity_score", "predicted_template", "prediction_prob", "max_z_score"]
    return sorted(
        tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(cols).collect()
    )


@pytest.mark.parametrize("cuts", [[], [1, 2, 90, 91, 200], [30, 60, 90, 120, 150, 180, 210, 240]])
def test_stream_equals_batch_however_it_is_cut(spark, tmp_path, models, cuts):
    tree, tfidf = models
    rows = lines(spark)
    batch = S.score_sequences(S.file_sequences(S.line_ids(frame(spark, rows), tree.vocab), W, bucket_rows=16), tree, tfidf)
    source = f"{tmp_path}/in"
    for low, high in zip([0, *cuts], [*cuts, len(rows)]):
        # a new query each time: it goes on from the checkpoint
        frame(spark, rows[low:high]).write.mode("append").parquet(source)
        stream = event_time_for_streams(spark.readStream.schema(SCHEMA).parquet(source))
        S.score_lines(stream, tree, tfidf, f"{tmp_path}/out", f"{tmp_path}/check", available_now=True).awaitTermination()
    got = plain(spark.read.parquet(f"{tmp_path}/out/scores"))
    want = plain(batch)
    assert got == want and len(got) == sum(max(0, sum(r[1] == f for r in rows) - W + 1) for f in ("a.log", "b.log", "c.log"))
    assert sum(r[5] is None for r in got) == sum(sum(r[1] == f for r in rows) >= W for f in ("a.log", "b.log", "c.log"))


def test_batch_sequences_by_hand(spark, models):
    tree = models[0]
    ids = S.line_ids(frame(spark, lines(spark)), tree.vocab)
    by_file = {}
    for r in ids.orderBy("file_path", "line_number").collect():
        by_file.setdefault(r.file_path, []).append(r)
    want = {
        (f, i): ([x.template_id for x in rows[max(0, i - W):i + 1]], max(x.severity_score for x in rows[i - W + 1:i + 1]))
        for f, rows in by_file.items() for i in range(W - 1, len(rows))
    }
    found = S.file_sequences(ids, W, bucket_rows=8).collect()
    assert {(r.file_path, r.position): (r.sequence, r.max_severity_score) for r in found} == want


def test_idle_file_is_forgotten(spark, tmp_path, models):
    tree = models[0]

    def log(hour, minute, name, number):
        return (f"2025-07-02 {hour:02d}:{minute:02d}:00", name, number, "INFO", "queue drained")

    parts = [
        [log(10, i, "a.log", i + 1) for i in range(3)],
        [log(15, 0, "b.log", 1)],  # moves the watermark hours past a.log
        [log(15, 1, "b.log", 2)],
        [log(15, 2 + i, "a.log", 4 + i) for i in range(4)],
    ]
    source = f"{tmp_path}/in"
    for rows in parts:
        frame(spark, rows).write.mode("append").parquet(source)
        stream = S.line_ids(event_time_for_streams(spark.readStream.schema(SCHEMA).parquet(source)), tree.vocab)
        found = S.carried_sequences(stream, W, idle="1 hour").writeStream.trigger(availableNow=True)
        found.option("checkpointLocation", f"{tmp_path}/check").format("parquet").start(f"{tmp_path}/out").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").filter("file_path = 'a.log'").collect()
    assert [(r.position, r.line_number) for r in rows] == [(3, 7)]  # counted from the line that came back
