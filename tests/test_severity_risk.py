import pytest
from pyspark.sql import functions as F

from logsieve.functions import risk, severity
from logsieve.functions.rowfeatures import ROW_FEATURES, row_features
from logsieve.operators.severities import attach_severity, severity_summary, top_exceptions

LINES = [
    # level, message, score, bucket, status, exception
    ("INFO", "took 500 ms", 10, "CRITICAL", "HTTP_500", None),
    ("INFO", "status: 404", 4, "LOW", "HTTP_404", None),
    ("INFO", "code: 12345", 1, "LOW", None, None),
    ("INFO", "HTTP/1.1 204", 1, "LOW", None, None),
    ("INFO", "200 then 500", 1, "LOW", None, None),
    ("INFO", "returned: 503x", 10, "CRITICAL", "HTTP_503", None),
    ("DEBUG", "error code한500", 0, "INFO", None, None),
    ("INFO", "nullpointerexception", 1, "LOW", None, None),
    ("INFO", "UncheckedIOException", 8, "HIGH", None, "IOException"),
    ("INFO", "ArrayIndexOutOfBoundsException", 6, "MEDIUM", None, "ArrayIndexOutOfBoundsException"),
    ("INFO", "FileNotFoundException", 4, "LOW", None, "FileNotFoundException"),
    ("INFO", "MyError", 5, "MEDIUM", None, "UnknownException"),
    ("INFO", "sqlexception then RuntimeException", 6, "MEDIUM", None, "RuntimeException"),
    ("warn", "disk", 5, "MEDIUM", None, None),
    ("TRACE", "", 0, "INFO", None, None),
    ("odd", "x", 0, "INFO", None, None),
]


def test_row_severity(spark):
    rows = [(i, a, b) for i, (a, b, *_) in enumerate(LINES)]
    out = severity.with_severity(spark.createDataFrame(rows, "i int, level string, message string")).orderBy("i").collect()
    got = [(r["level"], r["message"], r["severity_score"], r["severity_level"], r["http_status_code"], r["exception_type"]) for r in out]
    assert got == LINES


def test_weights():
    weights = severity.HTTP_STATUS_WEIGHTS
    assert len(weights) == 41 and weights["503"] == 10 and weights["304"] == 0
    assert len(severity.exception_weights()) == 29


def test_summary_and_dispatch(spark):
    df = severity.with_severity(spark.createDataFrame([(a, b) for a, b, *_ in LINES], "level string, message string"))
    row = severity_summary(df).first()
    assert (row["total_anomalies"], row["critical_count"], row["max_severity_score"]) == (16, 2, 10)
    assert top_exceptions(df, 2).count() == 2
    plain = spark.createDataFrame([(1,)], "x int")
    assert attach_severity(plain, df) is plain
    assert "severity_score" in attach_severity(spark.createDataFrame([("INFO", "m")], "level string, message string"), df).columns


def score(spark, anomaly, sev, text):
    df = spark.createDataFrame([(anomaly, sev, text)], "a double, s int, t string")
    out = df.select(risk.risk_score(F.col("a"), F.col("s"), F.col("t")).alias("r"))
    return out.select("r", risk.risk_bucket(F.col("r"))).first()


def test_risk_branches(spark):
    normal = "==> Parameters: 1"
    value, level = score(spark, 2.724382412180263, 1, normal)
    assert value == pytest.approx(41.86573618270395, abs=1e-12) and level == "MEDIUM"
    assert score(spark, 9.0, 10, normal) == (79.0, "HIGH")
    assert score(spark, 1.0, 8, "java.lang.RuntimeException: x") == (116.0, "CRITICAL")
    assert score(spark, 3.0, 10, "timeout") == (150.0, "CRITICAL")
    assert score(spark, 1.0, 5, "plain text") == (40.0, "MEDIUM")
    assert score(spark, 0.6, 1, "plain text")[1] == "INFO"
    assert score(spark, 0.8, 0, "plain text") == (20.0, "LOW")
    assert score(spark, 0.0, 20, "plain text") == (60.0, "HIGH")
    assert score(spark, 9.0, 10, "plain text") == (79.0, "HIGH")
    # "error=null" says that there was no error, also next to a real keyword
    assert score(spark, 1.0, 5, "exception seen, error=null") == (40.0, "MEDIUM")
    assert score(spark, 1.0, 5, "a doFilterInternal call") == (40.0, "MEDIUM")


def test_row_features(spark):
    df = spark.createDataFrame(
        [("WARN", True, 11, "1234567", "c", "t", "Null Error!?"), ("TRACE", False, 0, "x", "c", "t", "")],
        "level string, has_exception boolean, message_length int, pid string, class_path string, thread string, message string",
    )
    assert len(ROW_FEATURES) == 22
    first, second = row_features(df).collect()
    assert (first["level_warn"], first["pid_part"], first["kw_null"], first["kw_error"], first["word_count"]) == (1, 0.567, 1, 1, 2)
    assert first["special_share"] == pytest.approx(2 / 12)
    assert sum(second[c] for c in ROW_FEATURES if c.startswith("level_")) == 0
    assert (second["pid_part"], second["word_count"], second["special_share"]) == (0, 0, 0)
    assert first["class_bucket"] == second["class_bucket"]
