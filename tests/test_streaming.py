from pyspark.sql import functions as F

from logsieve.functions.severity import with_severity
from logsieve.operators.baseline import fit_baseline
from logsieve.operators.windows import WINDOW, WINDOW_FEATURES, window_features
from logsieve.sources.events import event_lines
from logsieve.sources.logs import read_logs
from logsieve.streaming import alerts, open_window_features, read_log_stream, row_severity, score_batches, window_features_stream

SF = "/root/testdata/sf0.001"


def run(stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def write_day(spark, folder, name, lines):
    (folder / name).write_text("\n".join(r["value"] for r in lines) + "\n")


def test_stream_equals_batch_for_closed_windows(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id")
    lines = event_lines(events).orderBy("line_number").collect()
    for i in range(4):
        write_day(spark, tmp_path, f"{i}.log", lines[i * 250:(i + 1) * 250])
    out = run(window_features_stream(read_log_stream(spark, str(tmp_path)), "6 hours"), "feats")
    batch = window_features(read_logs(spark, str(tmp_path)), "6 hours")
    cols = [WINDOW, *WINDOW_FEATURES, "is_error_count", "top_class"]
    got = {r[WINDOW]: r for r in out.select(cols).collect()}
    want = {r[WINDOW]: r for r in batch.select(cols).collect()}
    rest = open_window_features(read_logs(spark, str(tmp_path)), "6 hours")
    left = {r[WINDOW]: r for r in rest.select(cols).collect()}
    assert not set(got) & set(left)
    assert got | left == want


def test_late_rows_are_dropped(spark, tmp_path):
    def row(hour, minute):
        return f"2025-07-02 {hour:02d}:{minute:02d}:00.000 INFO 1 --- [t] a.B : m\n"

    path = tmp_path / "in"
    path.mkdir()
    (path / "1.log").write_text(row(10, 1) + row(10, 2))
    stream = window_features_stream(read_log_stream(spark, str(path)))
    query = stream.writeStream.format("memory").queryName("late").outputMode("append").start()
    query.processAllAvailable()
    (path / "2.log").write_text(row(12, 0))
    query.processAllAvailable()
    (path / "3.log").write_text(row(10, 3) + row(13, 0))
    query.processAllAvailable()
    query.stop()
    rows = {r[WINDOW].hour: r["total_logs"] for r in spark.table("late").collect()}
    assert rows[10] == 2


def test_alerts_and_severity(spark, tmp_path):
    head = "2025-07-02 10:{m:02d}:0{s}.000 {level} 1 --- [t] a.B : {text}\n"
    quiet = "".join(head.format(m=m, s=s, level="INFO", text="ok") for m in range(0, 60, 10) for s in range(3 + m % 3))
    (tmp_path / "a.log").write_text(quiet)
    baseline = fit_baseline(window_features(read_logs(spark, str(tmp_path))))
    (tmp_path / "b.log").write_text("".join(head.format(m=5, s=s, level="ERROR", text="Request failed status 500") for s in range(9)).replace(" 10:", " 11:"))
    (tmp_path / "c.log").write_text(head.format(m=0, s=0, level="INFO", text="end").replace(" 10:", " 14:"))
    feats = window_features_stream(read_log_stream(spark, str(tmp_path)))
    found = alerts(feats, baseline)
    spikes = run(found["error_spikes"], "spikes").collect()
    assert [(r[WINDOW].hour, r["error_count"], r["current_error_rate"]) for r in spikes] == [(11, 9, 1.0)]
    assert [r[WINDOW].hour for r in run(found["zscore"], "zs").collect()] == [11]
    lines = run(row_severity(read_log_stream(spark, str(tmp_path))), "sev")
    batch = with_severity(read_logs(spark, str(tmp_path)))
    count = lambda df: {r[0]: r[1] for r in df.groupBy("severity_level").agg(F.count("*")).collect()}
    assert count(lines) == count(batch)


def test_batches_write_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.log").write_text("2025-07-02 10:00:00.000 ERROR 1 --- [t] a.B : x\n" * 3)
    for _ in range(2):
        stream = read_log_stream(spark, str(source))
        query = score_batches(
            stream, lambda df: {"severity": with_severity(df)}, f"{tmp_path}/out", f"{tmp_path}/ck", available_now=True
        )
        query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/severity").count() == 3
