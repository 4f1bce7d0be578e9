import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from logsieve.plans import windows as P
from logsieve.sources import logs as L
from logsieve.sources import sinks as K
from logsieve.sources.events import event_logs
from logsieve.operators.windows import window_features
from logsieve import scratch

SF = "/root/testdata/sf0.001"


def line(i, minute=0, text=None):
    return f"2025-07-02 15:{minute:02d}:{i % 60:02d}.000  INFO 1 --- [ main] a.B : {text or f'row {i}'}"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("logs")
    (path / "b.log").write_text("\n".join(line(i) for i in range(400)) + "\n")
    (path / "a.log").write_bytes(b"no log line\n" + line(0, text="caf").encode() + b"\xff\xfe\xc3\xa9\r\n\n" + line(1).encode())
    (path / "skip.txt").write_text(line(1))
    (path / "sub").mkdir()
    (path / "sub" / "c.log").write_text(line(1))
    return str(path)


def test_lines_and_numbers_over_many_splits(spark, folder):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        rows = L.read_lines(spark, folder).filter("file_path = 'b.log'").orderBy("line_number").collect()
        numbers = [r["line_number"] for r in rows]
        parts = L.read_lines(spark, folder, line_numbers=False).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert parts > 5
    assert numbers == list(range(1, 401))
    assert [r["value"] for r in rows] == [line(i) for i in range(400)]


def test_folder_scan(spark, folder):
    logs = L.read_logs(spark, folder)
    rows = logs.filter("file_path = 'a.log'").orderBy("line_number").collect()
    assert [(r["line_number"], r["message"]) for r in rows] == [(2, "café"), (4, "row 1")]
    assert logs.count() == 402 and {r[0] for r in logs.select("file_path").distinct().collect()} == {"a.log", "b.log"}


def test_limits(spark, folder):
    assert {r[0] for r in L.read_logs(spark, folder, max_files=1).select("file_path").collect()} == {"a.log"}
    assert L.read_logs(spark, folder, sample_lines=3).count() == 1 + 3
    first = L.read_logs(spark, folder, max_total_lines=5).collect()
    assert sorted((r["file_path"], r["line_number"]) for r in first) == [("a.log", 2), ("a.log", 4), ("b.log", 1), ("b.log", 2), ("b.log", 3)]
    assert L.read_logs(spark, f"{folder}/b.log").count() == 400


def test_total_limit_over_files_and_splits(spark, tmp_path):
    for f in range(7):
        rows = [line(i, text=f"f{f} {i}") if i % 3 else "no log line" for i in range(60 * f)]
        (tmp_path / f"n {f}.log").write_text("\n".join(rows) + "\n")
    whole = [(r["file_path"], r["line_number"], r["message"]) for r in L.read_logs(spark, str(tmp_path)).orderBy("file_path", "line_number").collect()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        for rows in (0, 1, 40, 41, 333, len(whole) + 5):
            got = L.read_logs(spark, str(tmp_path), max_total_lines=rows)
            assert sorted((r["file_path"], r["line_number"], r["message"]) for r in got.collect()) == sorted(whole[:rows])
            assert not any(w in plan_of(got) for w in ("GlobalLimit", "TakeOrdered")) or rows == 0
        assert {f.rsplit("/", 1)[1] for f in L.read_logs(spark, str(tmp_path), max_total_lines=41).inputFiles()} == {"n%201.log", "n%202.log"}
        few = L.read_logs(spark, str(tmp_path), max_files=4, sample_lines=50, max_total_lines=80)
        assert sorted((r["file_path"], r["line_number"]) for r in few.collect()) == [x[:2] for x in whole if x[0] < "n%204" and x[1] <= 50][:80]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_parsed_tables(spark, folder, tmp_path):
    logs = L.read_logs(spark, folder)
    K.write_parsed(logs.repartition(1), f"{tmp_path}/parsed", chunk_rows=100)
    back = L.read_parsed(spark, f"{tmp_path}/parsed")
    assert back.count() == 402 and len(back.inputFiles()) == 5
    assert L.read_parsed(spark, f"{tmp_path}/parsed", max_files=2).count() == 200
    K.write_split(back.withColumn("split", F.when(F.col("line_number") < 100, "train").otherwise("test")), f"{tmp_path}/split")
    train = L.read_split(spark, f"{tmp_path}/split", "train")
    assert train.count() == 2 + 99
    assert "PartitionFilters: [isnotnull(split" in train._jdf.queryExecution().executedPlan().toString()


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("LOW", 1, ["a", "b"]), ("HIGH", 2, ["c"])], "risk_level string, n int, xs array<string>")
    path = str(tmp_path)
    assert K.next_run_id(spark, f"{path}/none") == "0"
    for _ in range(2):
        K.write_results({"risk": df}, path, K.next_run_id(spark, path))
    assert K.run_ids(spark, path) == ["0", "1"] and K.latest_run(spark, path).endswith("run_id=1")
    rows = spark.read.option("header", True).csv(f"{path}/run_id=1/risk").orderBy("n").collect()
    assert [tuple(r) for r in rows] == [("LOW", "1", "a, b"), ("HIGH", "2", "c")]
    K.write_risk_slices(df.drop("xs"), f"{path}/slices")
    assert spark.read.option("header", True).csv(f"{path}/slices/risk_level=HIGH").count() == 1
    K.write_text_report(spark.createDataFrame([(2, "b"), (1, "a")], "position int, value string"), f"{path}/text")
    assert [r[0] for r in spark.read.text(f"{path}/text").collect()] == ["a", "b"]


def test_state_round_trip(spark, tmp_path):
    logs = event_logs(spark, SF)
    parted = P.split_features(window_features(logs, "6 hours"))
    train, test = (parted.filter(F.col("split") == s) for s in ("train", "test"))
    state = P.fit(train, width="6 hours")
    P.save(state, f"{tmp_path}/state")
    loaded = P.load(spark, f"{tmp_path}/state")
    assert set(loaded.models) == {"isolation_forest", "autoencoder"}
    for name in state.models:
        a = P.score_model(test, state, name).orderBy("time_window").select("anomaly_score", "is_anomaly").collect()
        assert a == P.score_model(test, loaded, name).orderBy("time_window").select("anomaly_score", "is_anomaly").collect()
        assert P.validate(parted.filter(F.col("split") != "train"), state, name).count() <= 1
    results = P.detect_new(logs, loaded, severity=True)
    assert set(results) == {"zscore", "error_spikes", "unusual_patterns", "isolation_forest", "autoencoder"}
    assert "max_severity_level" in results["zscore"].columns
    with pytest.raises(ValueError):  # too few windows for the auto-encoder
        P.fit(train.limit(5), width="6 hours")


def test_scratch_tables(spark):
    df = scratch.materialize(spark.range(10), "check")
    assert df.count() == 10 and "/logsieve/check-" in df.inputFiles()[0]
    assert df.inputFiles()[0].replace("file://", "").startswith(scratch.scratch_dir(spark))
