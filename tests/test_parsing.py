from datetime import datetime

from pyspark.sql import functions as F

from logsieve.functions import parsing
from logsieve.functions.templates import template, terms

HEAD = "2024-03-09 07:08:09.010  INFO 4711 --- [   worker-3] org.sample.Engine : Starting"


def parse(spark, *lines):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "n int, value string")
    return {r["n"]: r for r in parsing.parse_lines(df).collect()}


def test_fields(spark):
    row = parse(spark, HEAD)[0]
    assert row["timestamp"] == datetime(2024, 3, 9, 7, 8, 9, 10000)
    assert (row["level"], row["pid"], row["thread"]) == ("INFO", "4711", "worker-3")
    assert (row["class_path"], row["message"], row["message_length"]) == ("org.sample.Engine", "Starting", 8)
    assert not row["is_error"] and not row["has_exception"]


def test_odd_lines(spark):
    rows = parse(
        spark,
        "\tat com.x.Y.z(Y.java:10)",
        "2025-07-02 15:59:36.514 INFO 1 --- [t] a.B no colon here",
        "2025-07-02 15:59:36.514 INFO 1 --- [t] a.B :",
        "2025-07-02  15:59:36.514 INFO 1 --- [t] a.B : two blanks",
        "2025-07-02 15:59:36.514 INFO 1 --- [t] a.B : 한국어 메시지",
        "2025-07-02 15:59:36.514 info 1 --- [t] a.B : lower",
        "2025-13-02 15:59:36.514 INFO 1 --- [t] a.B : month 13",
        "  2025-07-02 15:59:36.514 INFO 1 --- [t] a.B: colon at once  ",
        "2025-12-08 18:26:55 - INFO - another format",
        "x 2025-07-02 15:59:36.514 INFO 1 --- [t] a.B : not at the start",
        "2025-07-02 15:59:36.514\u00a0INFO\u20031 --- [t] a.B : wide blanks\u3000",
    )
    assert sorted(rows) == [1, 2, 3, 4, 5, 6, 7, 10]
    assert rows[1]["message"] == "no colon here"
    assert rows[2]["message"] == ""
    assert rows[3]["timestamp"] == datetime(2025, 7, 2, 15, 59, 36, 514000)
    assert rows[4]["message_length"] == 7
    assert rows[5]["level"] == "info"
    assert rows[6]["timestamp"] is None
    assert rows[7]["message"] == "colon at once"
    assert rows[10]["message"] == "wide blanks"


def test_error_rules(spark):
    rows = parse(
        spark,
        HEAD.replace("INFO", "FATAL"),
        HEAD.replace("Starting", "Connection refused by peer"),
        HEAD.replace("Starting", "a TIMEOUT"),
        HEAD.replace("Starting", "an Error"),
        HEAD.replace("Starting", "a warning"),
    )
    assert [rows[i]["is_error"] for i in range(5)] == [True, True, True, True, False]
    assert [rows[i]["has_exception"] for i in range(5)] == [False, False, False, True, False]


def test_the_pattern_runs_once(spark):
    lines = spark.createDataFrame([(HEAD,)], "value string")
    plan = parsing.parse_lines(lines).filter("is_error and length(message) > 3").groupBy("level").count()
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_replace(trim") == 1


def test_templates(spark):
    cases = {
        "took 35 ms": "took * ms",
        "to 10.1.2.3 now": "to *.*.*.* now",
        "open C:\\temp\\a.txt": "open C:/*",
        "read /var/log/x.log ok": "read /* ok",
        "id abcdefab-abcd-abcd-abcd-abcdefabcdef": "id *",
        "id 1bcdefab-abcd-abcd-abcd-abcdefabcdef": "id *bcdefab-abcd-abcd-abcd-abcdefabcdef",
        "at 2024-01-02T03:04:05": "at *-*-*T*:*:*",
        "  padded  ": "padded",
        "٣ items": "* items",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "m string").select("m", template(F.col("m")).alias("t"))
    assert {r["m"]: r["t"] for r in df.collect()} == cases


def test_specific_rules_first(spark):
    df = spark.createDataFrame([("at 2024-01-02T03:04:05 from 10.1.2.3",)], "m string")
    assert df.select(template(F.col("m"), True)).first()[0] == "at * from *"


def test_terms(spark):
    df = spark.createDataFrame([("User * signed in",), ("x",), ("",)], "m string")
    rows = [r[0] for r in df.select(terms(F.col("m"))).collect()]
    assert rows == [["user", "signed", "in", "user signed", "signed in"], [], []]
