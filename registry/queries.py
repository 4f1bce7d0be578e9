"""One query per operator, over whole tables.  Log lines come from ``events`` through the adapter."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from logsieve import scratch
from logsieve.functions import parsing, risk, rowfeatures, severity, templates
from logsieve.operators import baseline as B
from logsieve.operators import ensemble as N
from logsieve.operators import evaluate as E
from logsieve.operators import ordering as O
from logsieve.operators import overlap, risks, splits
from logsieve.operators import sequences as Q
from logsieve.operators import severities as S
from logsieve.operators import vocabulary as V
from logsieve.operators import windows as W
from logsieve.operators.detectors import (
    autoencoder, context_tree, copod, iforest, lof, neighbour_forest, ngram_next, order_classifier, pca_recon, rff_ocsvm, seq_classifier, temporal, tfidf_seq,
)
from logsieve.plans import compare as compare_plan
from logsieve.plans import rows as row_plan
from logsieve.plans import sequences as seq_plan
from logsieve.plans import temporal as temporal_plan
from logsieve.plans import windows as window_plan
from logsieve.sources import sinks
from logsieve.sources.events import dealt_events, event_lines, event_logs
from logsieve.sources.logs import read_logs, read_split
from logsieve.streaming import live
from logsieve.streaming import sequences as stream_seq

WIDE = "6 hours"
SHORT = 15
# The event log has few, evenly mixed templates: no sequence lies 3 deviations off.
THRESHOLD = 0.6
SIDE_BY_SIDE = {"tree": 0.9137, "tfidf": THRESHOLD, "ngram": 0.9137}
# Features without the hash bucket, whose value has no counterpart in SQL.
NUMERIC = [c for c in W.WINDOW_FEATURES if c != "top_class_hash"]
MODELS = {"length": ("s_length", "p_length"), "words": ("s_words", "p_words"), "special": ("s_special", "p_special")}


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: long integers, doubles to six places, times and arrays as text."""
    out = []
    for field in df.schema.fields:
        c, t = F.col(field.name), field.dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")
        elif isinstance(t, T.DateType):
            c = c.cast("string")
        elif isinstance(t, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        out.append(c.alias(field.name))
    return df.select(*out)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def templated(spark, sf):
    return V.with_template(event_logs(spark, sf))


def indexed(spark, sf):
    return O.index_logs(templated(spark, sf))


def features(spark, sf, width=WIDE):
    return W.window_features(event_logs(spark, sf), width)


def split_windows(spark, sf):
    """6-hour features with their split; written once, because fit and score both read them."""
    return window_plan.split_features(features(spark, sf))


def train_windows(parted):
    return parted.filter(F.col("split") == "train")


def scored_rows(spark, sf):
    """Three simple row scores with predictions, next to the error label."""
    logs = event_logs(spark, sf)
    text = F.lower("message")
    return logs.select(
        "line_number",
        F.col("is_error").cast("int").alias("y"),
        F.col("message_length").cast("double").alias("s_length"),
        rowfeatures.word_count(text).cast("double").alias("s_words"),
        (-rowfeatures.special_share(text)).alias("s_special"),
    ).withColumns({
        "p_length": (F.col("s_length") > 36).cast("int"),
        "p_words": (F.col("s_words") > 5).cast("int"),
        "p_special": (F.col("s_special") < -0.12).cast("int"),
    })


def model_rows(spark, sf):
    return N.long_predictions(scored_rows(spark, sf), MODELS)


def sequence_split(spark, sf):
    return seq_plan.train_test(event_logs(spark, sf))


def tfidf_anomalies(spark, sf, w=SHORT):
    split = sequence_split(spark, sf)
    return split, tfidf_seq.detect(split.test, tfidf_seq.fit(split.train, w), THRESHOLD)


def sequence_risks(spark, sf):
    return seq_plan.risk_chain(event_logs(spark, sf), threshold=THRESHOLD)


# ---- parsing and row expressions -------------------------------------------------------------------

def q_parse_lines(spark, sf):
    return event_logs(spark, sf)


def q_calendar_fields(spark, sf):
    logs = parsing.with_calendar(event_logs(spark, sf))
    return logs.select("line_number", "hour", "minute", "date", parsing.time_floor("timestamp").alias("time_window"))


def q_message_stats(spark, sf):
    return event_logs(spark, sf).groupBy("level", "is_error", "has_exception").agg(
        F.count("*").alias("n"), F.avg("message_length").alias("avg_length"), F.max("message_length").alias("max_length")
    )


def day_files(spark, sf):
    """Folder with one text file per day, in the order of the lines."""
    path = f"{scratch.scratch_dir(spark)}/logsieve/days-{uuid.uuid4().hex}"
    lines = event_lines(table(spark, sf, "events")).withColumn("day", F.regexp_extract("file_path", r"(\d+)\.log", 1))
    lines.repartition("day").sortWithinPartitions("day", "line_number").select("day", "value").write.partitionBy("day").text(path)
    return path


def q_read_limits(spark, sf):
    """The first physical lines of each file, and of those the first parsed rows, through the reader itself."""
    logs = read_logs(spark, f"{day_files(spark, sf)}/day=01", sample_lines=40, max_total_lines=30, pattern="part-*")
    return logs.select("line_number", "timestamp", "level", "message")


def q_read_first_rows(spark, sf):
    """The first files of the month, of each its first lines, and of those the first parsed rows: the limit falls inside a file."""
    logs = read_logs(spark, day_files(spark, sf), max_files=25, sample_lines=250, max_total_lines=4010, pattern="part-*")
    return logs.select("line_number", "timestamp", "level", "message")


def q_template_extract(spark, sf):
    return V.template_counts(templated(spark, sf))


def q_template_specific_first(spark, sf):
    return V.template_counts(V.with_template(event_logs(spark, sf), specific_first=True))


def q_text_templates(spark, sf):
    texts = table(spark, sf, "conversations").select(templates.template(F.col("text")).alias("template"))
    return V.template_counts(texts)


def q_text_shape(spark, sf):
    text = F.lower("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        rowfeatures.word_count(text).alias("words"),
        F.length(F.regexp_replace(text, r"[\p{L}\p{N} ]+", "")).alias("special"),
        F.length(templates.template(F.col("text"))).alias("template_length"),
    )


def q_row_severity(spark, sf):
    cols = [
        "line_number", "severity_score", "severity_level", "level_weight", "http_status_code", "http_status_weight",
        "exception_type", "exception_weight",
    ]
    return severity.with_severity(event_logs(spark, sf)).select(*cols)


def q_http_status(spark, sf):
    return event_logs(spark, sf).groupBy(severity.http_status(F.col("message")).alias("http_status_code")).agg(
        F.count("*").alias("n")
    )


def q_exception_type(spark, sf):
    return event_logs(spark, sf).groupBy(severity.exception_type(F.col("message")).alias("exception_type")).agg(
        F.count("*").alias("n")
    )


def q_row_features(spark, sf):
    cols = [c for c in rowfeatures.ROW_FEATURES if c not in ("class_bucket", "thread_bucket")]
    return rowfeatures.row_features(event_logs(spark, sf)).select("line_number", *cols)


def q_hash_features(spark, sf):
    rows = rowfeatures.row_features(event_logs(spark, sf))
    code = rowfeatures.message_code(F.col("message")).alias("message_code")
    return rows.select("line_number", "class_bucket", "thread_bucket", code)


def q_risk_flags(spark, sf):
    text = F.col("message")
    return event_logs(spark, sf).select(
        "line_number",
        risk.is_normal_query(text).alias("normal_query"),
        risk.is_false_positive(text).alias("false_positive"),
        risk.has_real_exception(text).alias("real_exception"),
    )


def q_risk_score_rows(spark, sf):
    logs = severity.with_severity(event_logs(spark, sf))
    score = risk.risk_score(F.col("message_length") / 20, F.col("severity_score"), F.col("message"))
    rated = logs.select("line_number", score.alias("risk_score"))
    return rated.withColumn("risk_level", risk.risk_bucket(F.col("risk_score")))


# ---- files and streams -----------------------------------------------------------------------------

def q_text_source(spark, sf):
    """Log lines written as one text file a day and scanned back, with their numbers within the file."""
    logs = read_logs(spark, day_files(spark, sf), pattern="part-*")
    return logs.select("line_number", "timestamp", "level", "pid", "thread", "class_path", "message", "is_error")


def q_detect_new(spark, sf):
    """Fitted state saved, loaded again, and applied to the later log lines: their error spikes."""
    logs = event_logs(spark, sf)
    parted = split_windows(spark, sf)
    path = f"{scratch.scratch_dir(spark)}/logsieve/state-{uuid.uuid4().hex}"
    window_plan.save(window_plan.fit(train_windows(parted), (), width=WIDE), path)
    start = parted.filter("split = 'test'").agg(F.min(W.WINDOW)).first()[0]
    later = logs.filter(F.col("timestamp") >= F.lit(start))
    return window_plan.detect_new(later, window_plan.load(spark, path))["error_spikes"]


def q_parsed_table(spark, sf):
    """Parsed table written in chunks, split into folders, and read back one split at a time."""
    path = f"{scratch.scratch_dir(spark)}/logsieve/parsed-{uuid.uuid4().hex}"
    sinks.write_split(splits.split_nested(event_logs(spark, sf)), path)
    return read_split(spark, path, "valid").groupBy("level", "is_error").agg(F.count("*").alias("n"))


def q_csv_report(spark, sf):
    """A result table written as CSV under a run number and read back."""
    path = f"{scratch.scratch_dir(spark)}/logsieve/report-{uuid.uuid4().hex}"
    sinks.write_results({"levels": W.level_distribution(event_logs(spark, sf))}, path, sinks.next_run_id(spark, path))
    return spark.read.option("header", True).schema("level string, n long, share double").csv(
        f"{sinks.latest_run(spark, path)}/levels"
    )


def run_stream(spark, sf, make):
    """Run a stream over ``events`` until the input is used up; the result is what was appended."""
    events = table(spark, sf, "events")
    source = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    logs = live.event_time_for_streams(parsing.parse_lines(event_lines(dealt_events(source))))
    out = f"{scratch.scratch_dir(spark)}/logsieve/stream-{uuid.uuid4().hex}"
    writer = make(logs).writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    writer.format("parquet").start(f"{out}/rows").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def q_stream_window_features(spark, sf):
    closed = run_stream(spark, sf, lambda logs: live.window_features_stream(logs, WIDE))
    return closed.unionByName(live.open_window_features(event_logs(spark, sf), WIDE)).drop("top_class_hash")


def q_stream_error_spikes(spark, sf):
    base = B.fit_baseline(train_windows(split_windows(spark, sf)), ["error_rate"])
    closed = run_stream(spark, sf, lambda logs: B.error_spikes(live.window_features_stream(logs, WIDE), base))
    return closed.unionByName(B.error_spikes(live.open_window_features(event_logs(spark, sf), WIDE), base))


def q_stream_zscore(spark, sf):
    base = B.fit_baseline(train_windows(split_windows(spark, sf)), NUMERIC)

    def alerts(features):
        return B.zscore_anomalies(features, base, cols=NUMERIC).select(W.WINDOW, "anomaly_score", "reasons")

    closed = run_stream(spark, sf, lambda logs: alerts(live.window_features_stream(logs, WIDE)))
    return closed.unionByName(alerts(live.open_window_features(event_logs(spark, sf), WIDE)))


def q_stream_row_severity(spark, sf):
    rows = run_stream(spark, sf, lambda logs: live.row_severity(logs).select("line_number", "severity_score", "severity_level"))
    return rows


def q_stream_sequence_scores(spark, sf):
    """Log lines in three pieces, each a run of the stream that goes on from the checkpoint of the one before."""
    train = sequence_split(spark, sf).train
    tree, tfidf = context_tree.fit(train, 10), tfidf_seq.fit(train, 10)
    events = table(spark, sf, "events")
    out = f"{scratch.scratch_dir(spark)}/logsieve/stream-{uuid.uuid4().hex}"
    cut = events.agg((F.max("event_id") + 1).alias("n")).first()["n"] or 1
    for piece in range(3):
        events.filter((F.col("event_id") * 3 / cut).cast("int") == piece).write.mode("append").parquet(f"{out}/in")
        source = spark.readStream.schema(events.schema).parquet(f"{out}/in")
        logs = live.event_time_for_streams(parsing.parse_lines(event_lines(dealt_events(source))))
        stream_seq.score_lines(logs, tree, tfidf, out, f"{out}/checkpoint", available_now=True).awaitTermination()
    return spark.read.parquet(f"{out}/scores").select("file_path", "position", "max_severity_score", "prediction_prob", "max_z_score")


# ---- filters ---------------------------------------------------------------------------------------

def q_split_classes(spark, sf):
    # each row is tagged with its sides: one pass over the text
    return splits.with_sides(event_logs(spark, sf)).groupBy("side", "level").agg(F.count("*").alias("n"))


# ---- aggregates ------------------------------------------------------------------------------------

def q_load_summary(spark, sf):
    return W.load_summary(event_logs(spark, sf))


def q_level_distribution(spark, sf):
    return W.level_distribution(event_logs(spark, sf))


def q_window_features(spark, sf):
    return W.window_features(event_logs(spark, sf)).drop("top_class_hash")


def q_window_features_wide(spark, sf):
    return features(spark, sf).drop("top_class_hash")


def q_level_counts(spark, sf):
    return W.level_counts(event_logs(spark, sf))


def q_top_class(spark, sf):
    return W.top_class(event_logs(spark, sf), WIDE)


def q_describe_features(spark, sf):
    return W.describe_features(features(spark, sf), NUMERIC)


def q_baseline_stats(spark, sf):
    return B.fit_baseline(train_windows(split_windows(spark, sf)), NUMERIC)


def q_row_baseline(spark, sf):
    rows = scored_rows(spark, sf)
    return B.fit_row_baseline(rows, ["s_length", "s_words", "s_special"])


def q_zscore_anomalies(spark, sf):
    parted = split_windows(spark, sf)
    found = B.zscore_anomalies(parted, B.fit_baseline(train_windows(parted), NUMERIC), cols=NUMERIC)
    return found.select(W.WINDOW, "anomaly_score", "reasons")


def q_error_spikes(spark, sf):
    parted = split_windows(spark, sf)
    return B.error_spikes(parted, B.fit_baseline(train_windows(parted), ["error_rate"]))


def q_error_concentration(spark, sf):
    return B.error_concentration(event_logs(spark, sf), share=0.01)


def q_frequency_anomalies(spark, sf):
    return B.frequency_anomalies(event_logs(spark, sf))


def q_rare_exceptions(spark, sf):
    return B.rare_exceptions(event_logs(spark, sf))


def q_unusual_patterns(spark, sf):
    # the log has no class with half of the errors: two of the three shapes appear
    return B.unusual_patterns(event_logs(spark, sf))


def q_scaled_features(spark, sf):
    parted = split_windows(spark, sf)
    scaler = B.fit_scaler(train_windows(parted), NUMERIC)
    return B.scale(parted, scaler, NUMERIC).select(W.WINDOW, *NUMERIC)


def q_flag_top(spark, sf):
    rows = scored_rows(spark, sf)
    return B.flag_top(rows, rows, "s_special").select("line_number", "is_anomaly")


def q_window_labels(spark, sf):
    parted = split_windows(spark, sf)
    base = B.fit_baseline(train_windows(parted), ["error_rate"])
    return B.label_windows(parted, base).select(W.WINDOW, "error_rate", "true_label")


def q_window_severity(spark, sf):
    logs = event_logs(spark, sf)
    return S.severity_agg(W.with_window(logs), [W.WINDOW])


def q_severity_summary(spark, sf):
    return S.severity_summary(severity.with_severity(event_logs(spark, sf)))


def q_top_exceptions(spark, sf):
    return S.top_exceptions(severity.with_severity(event_logs(spark, sf)))


def q_attach_severity(spark, sf):
    logs = event_logs(spark, sf)
    parted = split_windows(spark, sf)
    spikes = B.error_spikes(parted, B.fit_baseline(train_windows(parted), ["error_rate"]))
    return S.attach_severity(spikes, logs, WIDE)


def q_template_vectors(spark, sf):
    """Rows next to the length of their template vector: zero for templates outside the training rows."""
    logs = templated(spark, sf)
    vectors = V.tfidf_templates(logs.filter(~F.col("is_error")))
    return logs.join(vectors, "template", "left").groupBy("is_error").agg(
        F.count("*").alias("n"), F.sum(F.coalesce(F.size("dims"), F.lit(0))).alias("entries")
    )


def q_window_evaluation(spark, sf):
    parted = split_windows(spark, sf)
    base = B.fit_baseline(train_windows(parted), NUMERIC)
    found = B.zscore_anomalies(parted, base, cols=NUMERIC).select(W.WINDOW, F.lit(1).alias("pred_label"))
    labelled = B.label_windows(parted, base).join(found, W.WINDOW, "left").fillna(0, ["pred_label"])
    return E.classification_metrics(labelled, ["split"], "true_label", "pred_label")


# ---- order, sequences, splits, samples -------------------------------------------------------------

def q_row_index(spark, sf):
    return indexed(spark, sf).select("idx", "line_number", "timestamp")


def q_template_vocab(spark, sf):
    return V.template_vocab(templated(spark, sf))


def with_ids(spark, sf, unknown=0):
    logs = templated(spark, sf)
    rows = O.index_logs(logs)
    vocab = V.template_vocab(logs.filter(~F.col("is_error")))
    return V.with_template_id(rows, vocab, unknown).select("idx", "template_id")


def q_template_ids(spark, sf):
    return with_ids(spark, sf)


def q_sequence_ids(spark, sf):
    return Q.sequences(with_ids(spark, sf), "template_id", 10)


def q_sequence_steps(spark, sf):
    return Q.sequences(with_ids(spark, sf), "template_id", 10, step=3)


def q_sequence_spans(spark, sf):
    rows = indexed(spark, sf)
    return Q.spans(rows, 10, 3, O.row_count(rows))


def q_next_event_pairs(spark, sf):
    return Q.next_event_pairs(with_ids(spark, sf), 10)


def q_sequence_means(spark, sf):
    rows = indexed(spark, sf).select("idx", "message_length", F.col("is_error").cast("int").alias("e"))
    return Q.over_sequences(rows, SHORT, {"mean_length": F.avg("message_length"), "mean_errors": F.avg("e")})


def q_split_time(spark, sf):
    return splits.split_by_time(indexed(spark, sf)).select("idx", "line_number", "split")


def q_split_nested(spark, sf):
    return splits.split_nested(event_logs(spark, sf)).select("line_number", "split")


def q_split_nested_strict(spark, sf):
    return splits.split_nested(event_logs(spark, sf), split_rule="strict").select("line_number", "split")


def q_split_chunked(spark, sf):
    return splits.split_chunked(indexed(spark, sf), chunk_rows=700).select("idx", "split")


def q_split_chunked_exact(spark, sf):
    return splits.split_chunked(indexed(spark, sf)).groupBy("split").agg(
        F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")
    )


def q_first_share(spark, sf):
    laid = O.lay_out_logs(event_logs(spark, sf))
    normal = O.number_rows_within(laid.filter(~F.col("is_error")), [])
    return splits.first_share(normal).select("idx", "line_number")


def q_sample_systematic(spark, sf):
    return splits.sample_systematic(indexed(spark, sf), 300).select("idx", "line_number")


def q_sample_even(spark, sf):
    return splits.sample_even(indexed(spark, sf), 333).select("idx", "line_number")


def q_sample_random(spark, sf):
    return splits.sample_random(event_logs(spark, sf), 300, "line_number").select("line_number", "level")


# ---- sequence models -------------------------------------------------------------------------------

def q_tfidf_templates(spark, sf):
    return V.tfidf_entries(templated(spark, sf)).select("template", "term", "value")


def q_sequence_baseline(spark, sf):
    rows = indexed(spark, sf)
    return tfidf_seq.sequence_moments(rows, V.tfidf_entries(rows), SHORT).select("term", "mean", "std")


def q_tfidf_seq_anomalies(spark, sf):
    _, found = tfidf_anomalies(spark, sf)
    return found.select("sequence_index", "max_z_score", "anomaly_score")


def q_tfidf_seq_scores(spark, sf):
    split = sequence_split(spark, sf)
    return tfidf_seq.score(split.test, tfidf_seq.fit(split.train, 10))


def q_spread_scores(spark, sf):
    split, found = tfidf_anomalies(spark, sf)
    return Q.spread_scores(split.test, found)


def q_spread_raw_scores(spark, sf):
    split = sequence_split(spark, sf)
    scored = tfidf_seq.with_anomaly_score(tfidf_seq.score(split.test, tfidf_seq.fit(split.train, SHORT)), THRESHOLD)
    return Q.spread_scores(split.test, scored)


def q_sequence_severity(spark, sf):
    split, found = tfidf_anomalies(spark, sf)
    return seq_plan.with_severity(found, split.test)


def q_sequence_priority(spark, sf):
    split, found = tfidf_anomalies(spark, sf)
    ranked = S.prioritize(seq_plan.with_severity(found, split.test))
    return ranked.select("sequence_index", "max_severity_score", "priority")


def q_sequence_summary(spark, sf):
    split, found = tfidf_anomalies(spark, sf)
    return seq_plan.summary(seq_plan.with_severity(found, split.test))


def q_sequence_details(spark, sf):
    split, found = tfidf_anomalies(spark, sf)
    details = risks.sequence_details(found.select("sequence_index"), split.test)
    return details.select("sequence_index", "log_count", "log_levels", "sample_messages")


def q_sequence_members(spark, sf):
    split, found = tfidf_anomalies(spark, sf)
    rows = split.test.select("idx", "line_number")
    return Q.members(found.select("sequence_index"), SHORT).join(rows, "idx")


def q_sequence_risk(spark, sf):
    return sequence_risks(spark, sf).select(
        "sequence_index", "anomaly_score", "max_severity_score", "risk_score", "risk_level"
    )


def q_risk_distribution(spark, sf):
    return risks.risk_distribution(sequence_risks(spark, sf))


def q_risk_totals(spark, sf):
    return risks.risk_totals(sequence_risks(spark, sf))


def q_risk_top(spark, sf):
    return risks.top_by_risk(sequence_risks(spark, sf)).select("risk_level", "rank", "risk_score")


def q_ngram_next(spark, sf):
    split = sequence_split(spark, sf)
    scored = ngram_next.score(split.test, ngram_next.fit(split.train, 10, order=2))
    return scored.select("sequence_index", "prediction_prob", "anomaly_score")


def q_ngram_anomalies(spark, sf):
    split = sequence_split(spark, sf)
    found = ngram_next.detect(split.test, ngram_next.fit(split.train, 10, order=2), 0.9)
    return found.select("sequence_index", "predicted_template", "actual_template")


def q_context_tree(spark, sf):
    split = sequence_split(spark, sf)
    scored = context_tree.score(split.test, context_tree.fit(split.train, 10))
    return scored.select("sequence_index", "prediction_prob", "anomaly_score")


def q_seq_classifier(spark, sf):
    """Fitted on the earlier lines, scored on the later ones."""
    data = compare_plan.prepare(event_logs(spark, sf))
    return seq_classifier.detect(data.test, seq_classifier.fit(data.train))


def q_order_classifier(spark, sf):
    data = compare_plan.prepare(event_logs(spark, sf))
    return order_classifier.score(data.test, order_classifier.fit(data.train))


# ---- evaluation ------------------------------------------------------------------------------------

def q_confusion_metrics(spark, sf):
    return E.classification_metrics(model_rows(spark, sf), ["model"])


def q_roc_auc(spark, sf):
    return E.roc_auc(model_rows(spark, sf), ["model"])


def q_roc_points(spark, sf):
    return E.roc_points(model_rows(spark, sf), ["model"])


def q_pr_points(spark, sf):
    return E.pr_points(model_rows(spark, sf), ["model"])


def q_best_threshold(spark, sf):
    rows = scored_rows(spark, sf)
    return E.best_threshold(rows, "f1", 0.01, 0.01, y="y", score="s_length")


def q_best_threshold_balanced(spark, sf):
    rows = scored_rows(spark, sf)
    return E.best_threshold(rows, "balanced", 0.02, 0.5, y="y", score="s_words")


def q_target_check(spark, sf):
    return E.meets_target(E.classification_metrics(model_rows(spark, sf), ["model"])).select("model", "meets_target")


def q_best_model(spark, sf):
    return E.best_model(E.classification_metrics(model_rows(spark, sf), ["model"])).select("model", "total")


def q_compare_models(spark, sf):
    ranked = E.compare_models(E.classification_metrics(model_rows(spark, sf), ["model"]))
    return ranked.select("model", "rank_f1", "rank_accuracy", "rank_recall", "rank_precision")


def q_model_comparison(spark, sf):
    return compare_plan.compare(event_logs(spark, sf), ("ngram", "tfidf", "classifier")).drop("roc_auc", "total")


def q_row_model_comparison(spark, sf):
    models = ("isolation_forest", "autoencoder", "lof", "copod")
    return row_plan.evaluate(row_plan.prepare(event_logs(spark, sf)), models)


# ---- ensembles and overlaps ------------------------------------------------------------------------

SCORES = [s for s, _ in MODELS.values()]
PREDS = [p for _, p in MODELS.values()]


def q_vote_majority(spark, sf):
    return scored_rows(spark, sf).select("line_number", N.majority(PREDS).alias("ensemble_pred"))


def q_vote_tie(spark, sf):
    return scored_rows(spark, sf).select("line_number", N.majority(PREDS[:2]).alias("ensemble_pred"))


def q_vote_any(spark, sf):
    return scored_rows(spark, sf).select("line_number", N.any_vote(PREDS).alias("ensemble_pred"))


def q_vote_all(spark, sf):
    return scored_rows(spark, sf).select("line_number", N.all_votes(PREDS).alias("ensemble_pred"))


def q_vote_weighted(spark, sf):
    weights = {"s_length": 2.0, "s_words": 1.0, "s_special": 3.0}
    return N.weighted_vote(scored_rows(spark, sf), SCORES, weights).select("line_number", "ensemble_pred")


def q_mean_score(spark, sf):
    return N.ensemble_score(scored_rows(spark, sf), SCORES).select("line_number", "ensemble_score")


def q_weighted_score(spark, sf):
    weights = {"s_length": 2.0, "s_words": 1.0, "s_special": 3.0}
    return N.ensemble_score(scored_rows(spark, sf), SCORES, weights).select("line_number", "ensemble_score")


def q_f1_weights(spark, sf):
    return N.f1_weights(E.classification_metrics(model_rows(spark, sf), ["model"]))


def q_ensemble_comparison(spark, sf):
    cols = ["model", "kind", "tp", "tn", "fp", "fn", "f1", "roc_auc"]
    return N.compare_with_ensembles(scored_rows(spark, sf), MODELS).select(*cols)


def q_stacking(spark, sf):
    rows = scored_rows(spark, sf)
    return N.stack_predict(rows, SCORES, N.fit_stack(rows, SCORES)).select("line_number", "ensemble_score", "ensemble_pred")


def found_sets(spark, sf):
    """Rows of severity that three simple models flag, in the shape of sequence results."""
    rows = scored_rows(spark, sf).join(
        severity.with_severity(event_logs(spark, sf)).select("line_number", F.col("severity_level").alias("max_severity_level")),
        "line_number",
    )
    return {
        name: rows.filter(F.col(pred) == 1).select(F.col("line_number").alias("sequence_index"), "max_severity_level")
        for name, (_, pred) in MODELS.items()
    }


def q_overlap_all(spark, sf):
    return overlap.found_by_all(found_sets(spark, sf))


def q_overlap_unique(spark, sf):
    return overlap.found_by_one(found_sets(spark, sf))


def q_severity_by_model(spark, sf):
    return overlap.severity_by_model(found_sets(spark, sf))


def found_sequences(spark, sf):
    """What three fitted sequence models find side by side, after they were saved and loaded again."""
    split = sequence_split(spark, sf)
    names = ("tree", "tfidf", "ngram")
    path = f"{scratch.scratch_dir(spark)}/logsieve/models-{uuid.uuid4().hex}"
    seq_plan.save(seq_plan.fit_all(split.train, names), path)
    return seq_plan.detect_side_by_side(split.test, seq_plan.load(spark, path, names), SIDE_BY_SIDE)


def q_sequence_overlap_all(spark, sf):
    return seq_plan.compare_found(found_sequences(spark, sf))["all"]


def q_sequence_overlap_unique(spark, sf):
    return seq_plan.compare_found(found_sequences(spark, sf))["one"]


def q_sequence_severity_by_model(spark, sf):
    return seq_plan.compare_found(found_sequences(spark, sf))["severity"]


# ---- window detectors ------------------------------------------------------------------------------

def q_copod(spark, sf):
    return copod.score(O.materialize(features(spark, sf), "features"), NUMERIC, W.WINDOW)


def q_copod_new(spark, sf):
    """Later windows against the distribution of the training windows alone."""
    parted = O.materialize(split_windows(spark, sf), "features")
    return copod.score_new(parted.filter("split <> 'train'"), train_windows(parted), NUMERIC, W.WINDOW)


def q_lof_new(spark, sf):
    """Later windows against neighbours and densities of the training windows alone."""
    parted = O.materialize(split_windows(spark, sf), "features")
    scaled = B.scale(parted, B.fit_scaler(train_windows(parted), NUMERIC), NUMERIC)
    return lof.score_new(scaled.filter("split <> 'train'"), train_windows(scaled), NUMERIC).select(W.WINDOW, "anomaly_score")


def q_lof(spark, sf):
    parted = split_windows(spark, sf)
    scaled = B.scale(parted, B.fit_scaler(parted, NUMERIC), NUMERIC)
    return lof.score(scaled, NUMERIC).select(W.WINDOW, "anomaly_score")


def row_points(spark, sf):
    """The distinct scaled feature vectors of all rows."""
    keyed = event_logs(spark, sf).withColumn(row_plan.KEY, F.concat_ws(":", "file_path", F.col("line_number").cast("string")))
    rows = O.materialize(rowfeatures.row_features(keyed), "rows")
    rows = O.materialize(B.scale(rows, B.fit_scaler(rows, rowfeatures.ROW_FEATURES), rowfeatures.ROW_FEATURES), "scaled")
    return rows, lof.points(rows, rowfeatures.ROW_FEATURES)


def q_lof_rows(spark, sf):
    """Local outlier factor of every log line among all lines, neighbours by the forest at any size."""
    rows, _ = row_points(spark, sf)
    scored = lof.score(rows, rowfeatures.ROW_FEATURES, broadcast_points=0, trees=neighbour_forest.TREES)
    return scored.select(row_plan.KEY, "anomaly_score")


def q_lof_forest_recall(spark, sf):
    """Share of the true neighbours that the forest finds, for every hundredth distinct line."""
    _, pts = row_points(spark, sf)
    found = neighbour_forest.neighbours(pts, 20, pts.count(), pts)
    return neighbour_forest.recall(pts, found, 20)


def q_iforest(spark, sf):
    parted = split_windows(spark, sf)
    scored = iforest.score(parted, iforest.fit(train_windows(parted), W.WINDOW_FEATURES, W.WINDOW))
    return scored.select(W.WINDOW, "anomaly_score")


def q_autoencoder(spark, sf):
    parted = split_windows(spark, sf)
    scored = autoencoder.score(parted, autoencoder.fit(train_windows(parted), W.WINDOW_FEATURES))
    return scored.select(W.WINDOW, "anomaly_score")


def q_pca_recon(spark, sf):
    parted = split_windows(spark, sf)
    scored = pca_recon.score(parted, pca_recon.fit(train_windows(parted), W.WINDOW_FEATURES))
    return scored.select(W.WINDOW, "anomaly_score")


def q_rff_ocsvm(spark, sf):
    parted = split_windows(spark, sf)
    scored = rff_ocsvm.score(parted, rff_ocsvm.fit(train_windows(parted), W.WINDOW_FEATURES))
    return scored.select(W.WINDOW, "anomaly_score")


def temporal_parts(spark, sf):
    feats = O.materialize(features(spark, sf).select(W.WINDOW, *NUMERIC), "features")
    return feats, temporal.window_runs(feats, cols=NUMERIC)


def q_temporal_runs(spark, sf):
    _, runs = temporal_parts(spark, sf)
    n = len(NUMERIC)
    return runs.select(
        "sequence_index", F.col("time_windows")[0].alias("start_time"), F.element_at("time_windows", -1).alias("end_time"),
        F.col("flat")[0].alias("first_total"), F.col("flat")[n].alias("second_total"), F.col("flat")[10 * n - 1].alias("last_top"),
    )


def q_temporal_copod(spark, sf):
    _, runs = temporal_parts(spark, sf)
    scored = temporal.score(runs, temporal.fit(runs, "copod"))
    return scored.select("sequence_index", "anomaly_score", "is_anomaly")


def q_temporal_anomalies(spark, sf):
    feats, runs = temporal_parts(spark, sf)
    logs = event_logs(spark, sf)
    scored = temporal.score(runs, temporal.fit(runs, "copod")).filter("is_anomaly = 1")
    found = scored.select("sequence_index", "time_windows", "anomaly_score")
    return S.prioritize(temporal_plan.run_severity(found, logs, WIDE)).drop("time_windows")


def q_temporal_logs(spark, sf):
    _, runs = temporal_parts(spark, sf)
    found = temporal.score(runs, temporal.fit(runs, "copod")).filter("is_anomaly = 1")
    logs = temporal_plan.run_logs(found, event_logs(spark, sf), WIDE)
    return logs.groupBy("sequence_index", "level").agg(F.count("*").alias("n"))


def q_detect_all(spark, sf):
    # five results read the parsed lines
    logs = scratch.materialize(event_logs(spark, sf), "parsed")
    parted = window_plan.split_features(W.window_features(logs, WIDE))
    state = window_plan.fit(train_windows(parted), width=WIDE)
    results = window_plan.detect_all(parted.filter(F.col("split") == "test"), logs, state)
    parts = [df.select(F.lit(name).alias("detector"), W.WINDOW) for name, df in results.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("detector").agg(F.count("*").alias("n"))


ALL = {
    name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_")
}


def queries():
    def whole(fn):
        return lambda spark, sf_dir: tidy(fn(spark, sf_dir))

    return {name: whole(fn) for name, fn in ALL.items()}
