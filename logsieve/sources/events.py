"""Adapter: an ``events`` table rendered as Spring Boot log lines.

Only integer and text operations, so the lines are the same in any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.parsing import parse_lines


LEVEL = """CASE
  WHEN event_type = 'error' AND event_id % 7 = 0 THEN 'ERROR'
  WHEN ts >= timestamp_ntz'2024-01-28 12:00:00' AND ts < timestamp_ntz'2024-01-28 18:00:00' THEN 'ERROR'
  WHEN event_type = 'signup' THEN 'DEBUG'
  WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'TRACE'
  WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'WARN'
  ELSE 'INFO' END"""
MESSAGE = """CASE
  WHEN event_id = 4321 THEN 'com.acme.RareException: once'
  WHEN _level = 'ERROR' THEN element_at(array(
    concat('java.sql.SQLException: query failed after ', event_id, ' tries'),
    'java.lang.NullPointerException at com.x.Y',
    'java.lang.OutOfMemoryError: Java heap space',
    'Request failed status 500',
    'java.net.SocketTimeoutException: timeout',
    'com.acme.CustomError code: 503'), int(event_id % 6) + 1)
  ELSE element_at(array(
    concat('GET /api/v1/items/', user_id, ' returned: 200 in ', event_id, ' ms'),
    concat('Connection to 10.0.', user_id % 256, '.', event_id % 256, ':5432 established'),
    concat('binding parameter [', event_id % 9, '] as [TIMESTAMP] - [2024-01-02T03:04:05]'),
    concat('Completed POST /orders/', event_id, ' status: 404'),
    concat('Cache refresh took ', event_id, ' ms'),
    concat('User ', user_id, ' signed in from /var/log/app/', user_id, '.log'),
    concat('event ', event_type, ' handled')), least(int(event_id % 10), 6) + 1)
  END"""
LINE = f"""concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS'), '  ', _level, ' ', 1000 + user_id % 7,
  ' --- [ http-nio-8080-exec-', user_id % 5, '] c.e.', event_type, '.Svc', user_id % 11, ' : ', {MESSAGE})"""


def event_lines(events: DataFrame) -> DataFrame:
    """(value, file_path, line_number): one log line per event."""
    return events.selectExpr("*", f"{LEVEL} AS _level").selectExpr(
        f"{LINE} AS value",
        "concat('app-', date_format(ts, 'yyyy-MM-dd'), '.log') AS file_path",
        "event_id + 1 AS line_number",
    )


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed logs of the ``events`` table of a data folder."""
    return parse_lines(event_lines(dealt_events(spark.read.parquet(f"{sf_dir}/events.parquet"))))


def dealt_events(events: DataFrame) -> DataFrame:
    """Events dealt over all cores before their lines are parsed; of a table or a stream."""
    columns = ["event_id", "ts", "user_id", "event_type"]
    # the test tables come as one small file with one row group, which Spark can't split
    return events.select(*columns).repartition(events.sparkSession.sparkContext.defaultParallelism, "event_id")
