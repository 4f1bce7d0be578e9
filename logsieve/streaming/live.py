"""Window features, alerts and row severity on a stream of log lines.

Lines that arrive after the watermark has passed their window are dropped; batch analysis has no such
rule.  A window is emitted once, when it is closed.  ``open_window_features`` gives the windows that a run which
has come to the end of its input leaves open.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.parsing import parse_lines
from ..functions.severity import with_severity
from ..operators.baseline import error_spikes, zscore_anomalies
from ..operators.windows import WINDOW, WINDOW_FEATURES, window_features, with_window
from ..functions.text import stable_bucket


def read_log_stream(spark: SparkSession, path: str, pattern: str = "*.log", max_files: int | None = None) -> DataFrame:
    """Parsed logs of the files that appear in a folder; event time as TIMESTAMP, which watermarks need."""
    reader = spark.readStream.option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.text(path).select("value", F.col("_metadata.file_name").alias("file_path"))
    return event_time_for_streams(parse_lines(lines))


def event_time_for_streams(logs: DataFrame) -> DataFrame:
    """Event time as the instant with the same clock reading in UTC, whatever the zone of the session.

    Windows are cut on the UTC clock, so they start at the same readings as in a batch.
    """
    instant = F.from_utc_timestamp(F.col("timestamp").cast("timestamp"), F.current_timezone())
    return logs.filter(F.col("timestamp").isNotNull()).withColumn("timestamp", instant)


def _reading(instant: Column) -> Column:
    """The UTC clock reading of an instant, as a timestamp without zone."""
    return F.to_utc_timestamp(instant, F.current_timezone()).cast("timestamp_ntz")


def window_features_stream(logs: DataFrame, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """The window features of ``operators.windows`` over a stream, in append mode.

    Two chained aggregations: rows are summed per combination of class, thread, file and level, then the
    combinations of a window are folded.  State grows with the combinations of the open windows only.
    """
    combos = (
        logs.withWatermark("timestamp", late)
        .groupBy(F.window("timestamp", width).alias("_window"), "class_path", "thread", "file_path", "level")
        .agg(
            F.count("*").alias("n"),
            F.count_if("is_error").alias("errors"),
            F.count_if("has_exception").alias("exceptions"),
            F.sum(F.col("message_length").cast("long")).alias("chars"),
        )
    )
    n = F.sum("n")

    def level_rows(level: str):
        return F.sum(F.when(F.col("level") == level, F.col("n")).otherwise(0))

    folded = combos.groupBy("_window").agg(
        n.alias("total_logs"),
        level_rows("ERROR").alias("error_count"),
        level_rows("WARN").alias("warn_count"),
        (F.sum("errors") / n).alias("error_rate"),
        (level_rows("WARN") / n).alias("warn_rate"),
        F.size(F.collect_set("class_path")).cast("long").alias("unique_classes"),
        F.size(F.collect_set("thread")).cast("long").alias("unique_threads"),
        (F.sum("chars") / n).alias("avg_message_length"),
        F.sum("exceptions").alias("exception_count"),
        (F.sum("exceptions") / n).alias("exception_rate"),
        F.size(F.collect_set("file_path")).cast("long").alias("unique_files"),
        level_rows("INFO").alias("info_count"),
        level_rows("DEBUG").alias("debug_count"),
        F.sum("errors").alias("is_error_count"),
        F.collect_set("class_path").alias("_classes"),
        F.collect_list(F.struct("class_path", "n")).alias("_combos"),
    )

    def rows_of(name):
        return F.aggregate(
            "_combos", F.lit(0).cast("long"), lambda a, x: a + F.when(x["class_path"] == name, x["n"]).otherwise(0)
        )

    top = F.array_min(F.transform("_classes", lambda c: F.struct((-rows_of(c)).alias("n"), c.alias("class_path"))))
    return (
        folded.withColumn("_top", top)
        .withColumns({
            WINDOW: _reading(F.col("_window.start")),
            "top_class": F.col("_top.class_path"),
            "top_class_count": -F.col("_top.n"),
        })
        .withColumn("top_class_hash", stable_bucket(F.col("top_class")))
        .select(WINDOW, *WINDOW_FEATURES, "is_error_count", "top_class")
    )


def open_window_features(logs: DataFrame, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Batch features of the windows that the watermark has not passed at the end of the input."""
    mark = logs.agg((F.max("timestamp") - F.expr(f"interval {late}")).alias("mark")).first()["mark"]
    still = F.col(WINDOW) + F.expr(f"interval {width}") > F.lit(mark).cast("timestamp_ntz")
    return window_features(with_window(logs, width).filter(still).drop(WINDOW), width)


def alerts(features: DataFrame, baseline: DataFrame, threshold: float = 3.0, multiplier: float = 5.0) -> dict[str, DataFrame]:
    """Z-score and error-spike alerts of streamed features against a fixed baseline table."""
    return {
        "zscore": zscore_anomalies(features, baseline, threshold),
        "error_spikes": error_spikes(features, baseline, multiplier),
    }


def row_severity(logs: DataFrame) -> DataFrame:
    """Severity of each streamed line; no state."""
    return with_severity(logs)


def score_batches(
    stream: DataFrame, score: Callable[[DataFrame], dict[str, DataFrame]], path: str, checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Apply batch functions to every micro-batch and write each named result below ``path``.

    A batch writes to folders named by its number and replaces them when it is retried, so results
    appear exactly once.
    """
    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for name, df in score(batch).items():
                df.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
